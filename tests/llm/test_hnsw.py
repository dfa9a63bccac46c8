import math

import numpy as np
import pytest

from envlattice.llm import hnsw, queries


def brute(rows, threshold=0.98):
    ok = {}
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float64)
            ok[k] = (label, len(v), a / np.linalg.norm(a))
    n = [0] * len(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    by = {}
    for k, (label, d, a) in ok.items():
        by.setdefault((label, d), []).append((k, a))
    for members in by.values():
        m = np.array([a for _, a in members])
        near = m @ m.T >= threshold
        for x, y in zip(*np.nonzero(np.triu(near, 1))):
            p, q = members[x][0], members[y][0]
            n[p] += 1
            n[q] += 1
            root[find(p)] = find(q)
    name = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            name[find(k)] = min(name.get(find(k), i), i)
    return sorted(((i, n[k], name.get(find(k)), i is not None and i == name[find(k)]) for k, (i, _, _) in enumerate(rows)), key=str)


def got(df, cols=("id", "n_links", "component", "kept")):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("shard", [None, 60])
def test_table(spark, shard):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in vectors.select("vec_id", "embedding", "label").collect()]
    found, want = got(hnsw.near_duplicates(vectors, shard=shard)), brute(rows)
    links, all_links = sum(r[1] for r in found), sum(r[1] for r in want)
    assert 0.98 * all_links <= links <= all_links
    assert sum(a == b for a, b in zip(found, want, strict=True)) >= 0.98 * len(want)


def test_a_clump_larger_than_any_beam(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=32)
    rows = [(i, (centre + rng.normal(size=32) * 0.02).tolist(), 1) for i in range(700)]
    rows += [(1000 + i, rng.normal(size=32).tolist(), 1) for i in range(700)]
    rng.shuffle(rows)
    rows = [(int(i), v, int(x)) for i, v, x in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    assert got(hnsw.near_duplicates(df, shard=500)) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    e, f = [1.0, 0.0, 0.0], [0.999, 0.01, 0.0]
    rows = [(1, e, 1), (2, f, 1), (3, e, 2), (4, e, None), (5, None, 1), (6, [0.0] * 3, 1), (7, [1.0, None, 0.0], 1), (8, [nan, 1.0, 0.0], 1),
            (9, [inf, 0.0, 0.0], 1), (10, [], 1), (11, [1.0, 0.0], 1), (0, e, 1), (12, e, 1), (12, e, 1), (None, f, 1), (None, [0.0, 1.0, 0.0], 1), (None, [0.0, 1.0, 1e-3], 1)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, n int")
    assert got(hnsw.near_duplicates(df)) == brute(rows)
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_query_columns(spark):
    assert queries.op8_hnsw(spark, "/root/testdata/sf0.001").columns == ["vec_id", "n_links", "component_id", "kept"]


def test_rows_that_share_an_id_across_labels(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=8), rng.normal(size=8)
    near = lambda v: (v + rng.normal(size=8) * 1e-3).tolist()
    rows = [(1, near(a), 1), (2, near(a), 1), (1, near(b), 2), (3, near(b), 2), (4, near(b), 2), (1, near(a), 3), (5, near(b), 1), (5, near(a), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(hnsw.near_duplicates(df)) == brute(rows)


def test_recall_is_measured_where_links_are_rare(spark):
    v = np.random.default_rng(9).normal(size=(500, 16))
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(1000, (v[0] + 1e-3).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = hnsw.near_duplicates(df, shard=200)
    assert got(out) == brute(rows)
    assert 0.9 <= out.agg({"recall": "min"}).first()[0] <= 1
    graph = hnsw.Graph(v)
    assert (hnsw.probes(graph, 0.98) @ graph.exact.T >= 0.98).any(axis=1).all()


def sparse(n=600, pairs=20):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(n, 16))
    v[1 : 2 * pairs : 2] = v[0 : 2 * pairs : 2] + rng.normal(size=(pairs, 16)) * 0.01
    return v


@pytest.mark.parametrize("across", [False, True])
def test_a_search_that_finds_nothing_but_the_query_fails_the_audit(monkeypatch, across):
    v = sparse()
    a, b = (hnsw.Graph(v[::2]), hnsw.Graph(v[1::2])) if across else (hnsw.Graph(v), None)
    want = a.exact @ (b or a).exact.T >= 0.98
    if not across:
        np.fill_diagonal(want, False)
    monkeypatch.setattr(hnsw.Graph, "near", lambda g, q, t, beam: np.flatnonzero(g.exact @ q >= 1 - 1e-9))
    assert want.any() and (hnsw.link(a, b, 0.98)[0] == want).all()
    dense = hnsw.Graph(np.random.default_rng(5).normal(size=16) + np.random.default_rng(6).normal(size=(400, 16)) * 0.01)
    assert hnsw.link(dense, None, 0.98)[0].sum() > 400
