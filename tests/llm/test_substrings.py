import hashlib
import random

import numpy as np
import pytest

from envlattice.llm import substrings


def brute(rows, window):
    where = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for d, (_, w) in enumerate(split):
        for s in range(len(w) - window + 1):
            where.setdefault(tuple(w[s : s + window]), []).append((d, s))
    gone = [set() for _ in split]
    for places in where.values():
        if len(places) > 1:
            for d, s in places:
                gone[d].update(range(s, s + window))
    out = []
    for d, (i, w) in enumerate(split):
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone[d])
        out.append((i, len(w), len(gone[d]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(docs, window):
    return sorted((tuple(r) for r in substrings.digest(substrings.remove_repeated(docs, window)).collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs, 35) == brute(rows, 35)


@pytest.mark.parametrize("hot, shard", [(2000, 1 << 15), (3, 40)])
@pytest.mark.parametrize("window", [5, 12])
def test_few_words(spark, monkeypatch, window, hot, shard):
    monkeypatch.setattr(substrings, "HOT_ANCHOR", hot)
    monkeypatch.setattr(substrings, "SHARD", shard)
    rng = random.Random(window)
    rows = []
    for i in range(150):
        parts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))) for _ in range(3)]
        rows.append((i, "\n".join(parts)))
    rows += [(200, rows[3][1]), (200, "a " * 500), (201, "b c " * 300), (202, None), (203, ""), (3, rows[3][1]), (None, rows[5][1]), (None, "x y")]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, anchor int, words string")
    assert got(docs, window) == brute(rows, window)


def test_no_rows(spark):
    assert substrings.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_last_least():
    rng = np.random.default_rng(0)
    for width in range(1, 20):
        v = rng.integers(0, 4, 60)
        want = [max(j for j in range(i, i + width) if v[j] == min(v[i : i + width])) for i in range(60 - width + 1)]
        assert substrings.last_least(v, width).tolist() == want


def test_equal_windows_share_a_segment_hash():
    a = [str(i).encode() for i in range(200)]
    x, y = substrings.segments(a, 35), substrings.segments([b"q"] * 50 + a, 35)
    assert set(zip(x[0][1:-1].tolist(), x[1][1:-1].tolist())) <= set(zip(y[0].tolist(), y[1].tolist()))


def test_long_text(spark):
    words = [f"w{i * i % 7919}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[30_000:30_034])), (3, " ".join(words[100:135]))]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 35) == brute(rows, 35)


def test_thousands_of_rows_without_an_id_or_with_one_id(spark):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=45)) for _ in range(9000)]
    texts += [" ".join(texts[7].split()[3:40]), texts[8], texts[8]]
    rows = [(None if i % 2 else 4, t) for i, t in enumerate(texts)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 35) == brute(rows, 35)


@pytest.mark.parametrize("window", [70, 150, 300])
def test_long_windows(spark, window):
    words = [f"w{i * i % 7919}" for i in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join(["x"] * 9 + words[100 : 101 + window])), (3, " ".join(words[1000 : 999 + window]))]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), window) == brute(rows, window)
