import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from envlattice.llm import queries, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in earlier
            earlier.add(line)
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_base_counts_of_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: tuple(r)[1:7] for r in queries.op2_quality_votes(spark, "/root/testdata/sf0.01").collect()}
    assert found == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_odd_texts():
    for text in ["", " \n\t", "a", "é  ü", "x\n\nx\nx \nx", "a b " * 40, "w " * 9, "w " * 8, "\x0b\x1c\x85 nbsp\xa0x", "日本 | | #"]:
        assert quality.counts(text.encode())[:5] == brute(text)[:5], text


def test_kept_agrees_with_labels(spark):
    d = "/root/testdata/sf0.1"
    judged = queries.op2_quality_votes(spark, d).drop("quality").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    n = {(r.label, r.kept): r["count"] for r in judged.groupBy(F.col("quality").alias("label"), "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.005 * n[1, True]
    assert n.get((0, True), 0) <= 0.05 * n[0, False]


def test_nulls_clashing_columns_and_no_rows(spark):
    rows = [(1, None, 3, "k"), (2, "good words " * 3, 4, "k"), (2, "good words " * 3, 4, "k"), (None, "", 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int, kept string")
    out = quality.judge(docs)
    assert out.select("row.*").columns == docs.columns
    assert out.where("kept").count() == 0 and out.count() == 4
    assert quality.judge(docs.limit(0)).count() == 0


def test_estimated_accuracies_of_simulated_rules():
    rng = np.random.default_rng(3)
    good = rng.random(50_000) < 0.7
    right = np.array([0.97, 0.96, 0.95, 0.9, 0.8])
    says = np.where(rng.random((50_000, 5)) < right, good[:, None], ~good[:, None])
    votes = np.where(rng.random((50_000, 5)) < 0.2, 0, np.where(says, 1, -1))
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit(patterns, n.astype(float))
    odds = model.prior + sum(np.choose(votes[:, j] + 1, w) for j, w in enumerate(model.weights))
    assert ((odds > 0) == good).mean() > 0.97
    assert model.weights[0][0] < model.weights[-1][0] < 0 < model.weights[-1][2] < model.weights[0][2]


def test_a_rule_that_is_wrong_more_often_than_right_is_turned_round():
    rng = np.random.default_rng(4)
    good = rng.random(50_000) < 0.6
    says = np.where(rng.random((50_000, 5)) < [0.9, 0.9, 0.9, 0.9, 0.1], good[:, None], ~good[:, None])
    patterns, n = np.unique(np.where(says, 1, -1), axis=0, return_counts=True)
    weights = quality.fit(patterns, n.astype(float)).weights
    assert weights[0][0] < 0 < weights[0][2] and weights[4][2] < 0 < weights[4][0]
