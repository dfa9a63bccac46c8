import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from envlattice.llm import common, simhash
from envlattice.llm import components as component_rounds
from envlattice.llm.components import components

DIR = "/root/testdata/sf0.001"


def brute(rows, k=4, d=4):
    def fp(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {i: fp(t) for i, t in rows}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= d:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (fps[i], find(i)) for i in fps}


def got(df):
    return {r["id"]: (r["f0"] & (1 << 64) - 1, r["component"]) for r in df.collect()}


def test_matches_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(simhash.near_duplicates(docs)) == brute(rows)


def test_odd_texts(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (1, "a b"), (2, "A  B"), (4, "long " * 200_000), (7, "x y z"), (8, "q w e r t")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, f0 string, component int")
    found = got(simhash.near_duplicates(docs))
    assert found == brute(rows)
    assert found[9] == (0, 3) and found[2][1] == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).columns == ["id", "f0", "component"]
    assert simhash.near_duplicates(docs).count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "zz yy")], "doc_id long, text string")
    assert sorted((r.id or 0, r.component or 0) for r in simhash.near_duplicates(docs).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1)]


@pytest.mark.parametrize("d", [1, 2, 3, 4, 7])
def test_every_plan_finds_every_link(spark, d):
    rng = np.random.default_rng(d)
    base = [int(x) for x in rng.integers(-(2**63), 2**63, 20)]
    rows = []
    for f in base:
        for _ in range(4):
            for b in rng.choice(64, rng.integers(0, d + 1), replace=False):
                f ^= 1 << int(b)
            rows.append(int(np.uint64(f & (1 << 64) - 1).astype(np.int64)))
    prints = spark.createDataFrame(list(enumerate(dict.fromkeys(rows))), "id long, f0 long")
    found = {(r.a, r.b) for r in simhash.links(prints, ["f0"], d, [(0, *x) for x in simhash.segments(d)]).collect()}
    uniq = list(dict.fromkeys(rows))
    mask = (1 << 64) - 1
    assert found == {(a, b) for a, b in combinations(range(len(uniq)), 2) if ((uniq[a] ^ uniq[b]) & mask).bit_count() <= d}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 3000, (2000, 2))] + [(i, i + 1) for i in range(5000, 5100)] + [(7000, i) for i in range(6000, 6500)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for x in {y for e in edges if e[0] != e[1] for y in e}}
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("edges", "rounds"), [([(7, i) for i in range(8, 40)], 0), ([(1, 2), (2, 3)], 1), ([], 0)])
def test_components_run_no_round_for_links_that_are_stars(spark, monkeypatch, edges, rounds):
    ran = []
    monkeypatch.setattr(component_rounds, "_small_star", lambda e, f=component_rounds._small_star: ran.append(1) or f(e))
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.component) for r in found.collect()} == {(x, edges[0][0]) for e in edges for x in e}
    assert len(ran) == rounds


def test_a_round_sends_nothing_through_the_driver_and_deals_a_table_once(spark, tmp_path):
    # the driver keeps threads, classes and buffers of every exchange for a while, and a run has dozens of rounds
    spark.range(1, 1000).selectExpr("id AS a", "id DIV 2 AS b").where("b > 0").write.parquet(f"{tmp_path}/links")
    links = spark.read.parquet(f"{tmp_path}/links")
    after = component_rounds._small_star(component_rounds._large_star(links))
    assert {(r.a, r.b) for r in after.collect()} >= {(2, 1), (3, 1)}
    plan = after._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastExchange" not in plan
    assert len(re.findall(r"[-:] Exchange ", plan)) <= 7


def test_the_driver_gives_back_what_it_has_freed(spark):
    assert common.give_back_driver(spark)  # Java 17.0.9 and later


def edited(words, rate, rng):
    return [f"new{rng.integers(10**9)}" if rng.random() < rate else w for w in words]


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_deduplicate(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows, groups_of, n = [], [], 0
    for g in range(60):
        base = list(rng.choice(vocabulary, 300))
        copies = [base, *(edited(base, 0.01, rng) for _ in range(4 if g else 150))]
        groups_of.append([])
        for words in copies:
            groups_of[-1].append((n, words))
            rows.append((n, " ".join(words), "s"))
            n += 1
    rng.shuffle(rows)
    docs = spark.createDataFrame([(int(i), t, s, 1) for i, t, s in rows], "doc_id long, text string, f0 string, content int")
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert all(g[0][0] in kept for g in groups_of)  # nothing goes without a smaller copy that stays
    near = [(i, words, g[0][1]) for g in groups_of for i, words in g[1:]]
    sure = [i for i, words, base in near if jaccard(words, base) >= 0.85]
    assert len(sure) > 200 and sum(i in kept for i in sure) <= 0.02 * len(sure)


def test_deduplicate_leaves_unlike_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text.encode().lower().split() for r in docs.collect()}
    kept = {r.doc_id for r in simhash.deduplicate(docs).collect()}
    gone = set(texts) - kept
    assert gone
    for i in gone:
        assert any(texts[i] == texts[k] or len(texts[i]) > 4 and jaccard(texts[i], texts[k]) > 0.5 for k in kept | gone if k < i), i
    exact = {}
    for i in sorted(texts):
        exact.setdefault(tuple(texts[i]), i)
    assert all(exact[tuple(texts[i])] == i for i in kept)


def test_deduplicate_odd_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (None, "z y"), (None, "z y"), (3, None), (4, ""), (5, "q"), (5, "r s t u v w x y"),
            (6, "r s t u v w x y"), (7, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id or 0, r.text or "") for r in simhash.deduplicate(docs).collect()))
    assert found == [(0, "z y"), (1, "a b c"), (3, ""), (5, "q"), (5, "r s t u v w x y")]
    assert simhash.deduplicate(docs.limit(0)).count() == 0


@pytest.mark.parametrize("similarity, least", [(0.8, 0.9), (0.85, 0.97), (0.9, 0.99)])
def test_the_wide_plan_finds_pairs_at_the_threshold(similarity, least):
    words, distance, plan = simhash.wide_plan(0.8)
    rng = np.random.default_rng(3)
    differ = rng.random((8000, words, 64)) < simhash.expected_distance(similarity)
    candidate = np.zeros(8000, bool)
    for w, shift, width, radius in plan:
        candidate |= differ[:, w, shift : shift + width].sum(axis=1) <= radius
    near = differ[:, : simhash.CHECKED].sum(axis=(1, 2)) <= distance
    assert (candidate & near).mean() >= least


@pytest.mark.parametrize("similarity, least", [(0.8, 0.975), (0.85, 0.995), (0.9, 0.999)])
def test_permuted_words_find_pairs_at_the_threshold(spark, similarity, least):
    words, distance, plan = simhash.wide_plan(0.8)
    rng = np.random.default_rng(4)
    a = rng.random((4000, 64 * simhash.MADE)) < 0.5
    b = a ^ (rng.random(a.shape) < simhash.expected_distance(similarity))
    names = [f"f{j}" for j in range(simhash.MADE)]
    both = np.ascontiguousarray(np.packbits(np.concatenate([a, b]), axis=1, bitorder="little")).view(np.int64)
    prints = spark.createDataFrame([(i, *map(int, row)) for i, row in enumerate(both)], "id long, " + ", ".join(f"{n} long" for n in names))
    points, made = simhash.permuted(prints, names, names[:2], words)
    rows = np.array(sorted(tuple(r) for r in points.collect()))
    assert (rows[:, 1:3] == both[:, :2]).all() and len(made) == words
    x, y = np.ascontiguousarray(rows[:4000].T).T, np.ascontiguousarray(rows[4000:].T).T
    near = sum(np.bitwise_count((x[:, j] ^ y[:, j]).view(np.uint64)) for j in (1, 2)) <= distance
    candidate = np.zeros(4000, bool)
    for w, shift, width, radius in plan:
        candidate |= np.bitwise_count((x[:, 3 + w] ^ y[:, 3 + w]) >> shift & (1 << width) - 1) <= radius
    assert (candidate & near).mean() >= least


def test_deduplicate_at_the_threshold(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, similar = [], {}
    for g in range(800):
        base = list(rng.choice(vocabulary, 300))
        copy = list(base)
        for at in rng.choice(np.arange(5, 295, 10), rng.integers(5, 10), replace=False):
            copy[at] = f"new{rng.integers(10**9)}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
        similar[2 * g + 1] = jaccard(base, copy)
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    over, under = [i for i, x in similar.items() if 0.8 <= x < 0.85], [i for i, x in similar.items() if x < 0.8]
    assert len(over) > 200 and len(under) > 200
    assert all(i in kept for i in under) and sum(i in kept for i in over) <= 0.08 * len(over)


def test_a_large_group_just_below_the_similarity_lists_no_pairs(spark):
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    copies = [edited(base, 0.02, rng) for _ in range(600)]  # near the base, not near each other
    docs = spark.createDataFrame([(i + 1, " ".join(w)) for i, w in enumerate([base, *copies])], "doc_id long, text string")
    similar = [i + 2 for i, w in enumerate(copies) if jaccard(base, w) >= 0.8]
    kept = {r.doc_id for r in simhash.deduplicate(docs).collect()}
    assert len(similar) > 300 and 1 in kept and sum(i in kept for i in similar) <= 0.08 * len(similar)
    assert all(i in kept for i, w in enumerate(copies, 2) if jaccard(base, w) < 0.6)


def test_similar_texts_of_a_rough_group_are_joined_far_from_its_centre(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    rows = [(0, base)]
    for i in range(150):  # each too far from the base and the others, and a copy of each that is near to it only
        variant = list(base)
        for at in rng.choice(np.arange(5, 295, 10), 8, replace=False):
            variant[at] = f"new{rng.integers(10**9)}"
        rows += [(2 * i + 1, variant), (2 * i + 2, [*variant[:-3], "last", *variant[-2:]])]
    assert all(jaccard(base, w) < 0.8 for _, w in rows[1:]) and jaccard(rows[1][1], rows[2][1]) > 0.9
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").persist()
    want = {0, *range(1, 301, 2)}
    assert {r.doc_id for r in simhash.deduplicate(docs).collect()} == want
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 40)  # in many blocks
    assert {r.doc_id for r in simhash.deduplicate(docs).collect()} == want


def test_similar_classes_match_brute_force():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.choice(40, rng.integers(0, 30))) for _ in range(60)] + [np.empty(0, int)] * 2
    sets += [np.unique(np.append(x[:-1], 50)) for x in sets[:20]]
    classes = rng.permutation(len(sets)) // 2
    root = {int(c): int(c) for c in classes}

    def find(x):
        return x if root[x] == x else find(root[x])

    for (a, x), (b, y) in combinations(zip(classes.tolist(), map(set, sets), strict=True), 2):
        if not x | y or len(x & y) / len(x | y) >= 0.8:
            root[max(find(a), find(b))] = min(find(a), find(b))
    want = {c: find(c) for c in root}
    root = {c: c for c in root}
    for a, b in simhash.similar_classes(classes, sets, np.arange(len(sets)), 0.8):
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {c: find(c) for c in root} == want and len(set(want.values())) < len(want) - 5


def test_texts_without_ids_have_near_copies(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join(words)), (None, " ".join(words[:-1] + ["other"])), (7, " ".join(words[1:])), (None, "p q r s t u")]
    out = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 7]
