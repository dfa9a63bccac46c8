import pytest
from pyspark.sql import functions as F

from envlattice.llm import mixing
from tests.llm.oracle import assert_same


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, sf):
    assert_same(spark, "op1_mixing", f"/root/testdata/{sf}")


def reshared(sizes, weights, share, most):
    """Targets as the rule has it: what is above a limit is dealt out again until none is."""
    total, target, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        rest = total - sum(most * sizes[i] for i in range(len(sizes)) if i not in free)
        now = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if now[i] > most * sizes[i]}
        for i in free:
            target[i] = most * sizes[i] if i in over else now[i]
        if not over:
            break
        free -= over
    return target


def test_plan_by_hand(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    rows = [(i, "abcde"[i * i % 5] if i % 7 else None, "w " * (i % 13)) for i in range(300)]
    rows += [(None, "a", "x y"), (None, "a", "x y"), (5, "b", None), (5, "b", None), (900, "z", "q " * 3000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, size int, key int")
    found = mixing.plan(docs).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, reshared([sizes[s] for s in order], [[3, 1, 2][i % 3] for i in range(len(order))], 1.5, 2), strict=True))
    taken = dict.fromkeys(order, 0)
    for r in found:
        assert r.target == pytest.approx(want[r.row.source], abs=1e-6)
        assert r.source_size == sizes[r.row.source] and 0 <= r.taken <= 2 * r.size
        taken[r.row.source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in order)
    mixed = mixing.mix(mixing.plan(docs)).collect()
    assert [r.position for r in mixed] == sorted(r.position for r in mixed)
    copies = {}
    for r in mixed:
        copies[r.row.doc_id] = copies.get(r.row.doc_id, 0) + 1
    for r in found:
        if r.row.doc_id not in (None, 5) and r.size:
            assert copies.get(r.row.doc_id, 0) == -(-r.taken // r.size)


def test_no_rows_and_no_words(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.plan(docs).count() == 0 and mixing.mix(mixing.plan(docs)).count() == 0
    blank = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert [r.taken for r in mixing.plan(blank).collect()] == [0, 0] and mixing.mix(mixing.plan(blank)).count() == 0


@pytest.mark.parametrize("schedule", [[1.0, 1.0], [4.5, 1.5], [0.0, 1.0], [1.0, 0.0, 2.0], [3.0, 0.0, 0.0, 1.0]])
def test_inverse_of_the_integral(spark, schedule):
    n = len(schedule) - 1

    def integral(x):
        total = 0.0
        for k in range(n):
            u = min(max(x - k / n, 0), 1 / n)
            total += schedule[k] * u + (schedule[k + 1] - schedule[k]) * n * u * u / 2
        return total

    df = spark.range(101).select((F.col("id") / 100).alias("f")).select("f", mixing.when(F.col("f"), F.array(*map(F.lit, schedule))).alias("x"))
    for r in df.collect():
        assert integral(r.x) == pytest.approx(r.f * integral(1), abs=1e-9)
