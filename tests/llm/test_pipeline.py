import re

import corpus_pipeline
from pyspark.sql import functions as F

from envlattice.llm import bpe, queries

D = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    (_, judge), (_, dedup), (_, scan), (_, mix), (_, encode) = corpus_pipeline.STAGES

    good = judge(spark, docs, D).cache()
    assert good.columns == docs.columns
    kept = {r.doc_id: r.text for r in good.collect()}
    assert kept.items() <= before.items()
    long_ = {i for i, t in before.items() if len(t.split()) >= 20}
    clean = {i for i, (q, _) in labels.items() if q == 1} & long_
    assert len(clean - set(kept)) <= 0.02 * len(clean)
    junk = {i for i, (q, _) in labels.items() if q == 0}
    assert len(junk & set(kept)) <= 0.05 * len(junk)

    single = dedup(spark, good, D).cache()
    assert single.columns == docs.columns
    texts = {r.doc_id: r.text for r in single.collect()}
    assert texts.items() <= kept.items() and len(set(texts.values())) == len(texts) == single.count()
    assert {t.lower() for t in texts.values()} == {t.lower() for t in texts.values()}

    safe = scan(spark, single, D).cache()
    masked = {r.doc_id: r for r in safe.collect()}
    assert safe.columns == docs.columns and masked.keys() == texts.keys()
    secret = re.compile(r"AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = \")[0-9a-f]{40}")
    for i, r in masked.items():
        assert r.text == secret.sub("<secret>", texts[i]) and r.n_chars == len(r.text)

    mixed = mix(spark, safe, D).cache()
    assert mixed.columns == docs.columns
    rows = mixed.groupBy("doc_id").count().collect()
    assert {r.doc_id for r in rows} <= masked.keys() and max(r["count"] for r in rows) <= 2
    words = lambda df: df.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert 0.9 < words(mixed) / words(safe) < 2

    out = encode(spark, mixed, D)
    vocabulary = bpe.load(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    got = out.collect()
    assert len(got) == mixed.count()
    for r in got:
        assert vocabulary.decode(bytes(r.ids)).decode() == masked[r.doc_id].text and len(r.ids) == 4 * r.n_tokens


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids", "place"] and out.count() > 50


def test_odd_rows_through_all_stages(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from all those who would follow it far into the night of june"
    rows = [(1, text, "en", "a", 3), (1, text, "en", "a", 3), (2, None, None, None, None), (3, "", "en", None, 0), (None, text + " x", "en", "b", 1), (4, text.upper(), "en", None, 1)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, D)
        assert frame.columns == ["doc_id", "n_tokens", "ids", "place"]
        frame.collect()


def test_tokens_have_the_place_that_the_mix_wrote(spark, tmp_path):
    rows = [(i * 7 % 60, f"word {i} " * (1 + i), "a") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    place = F.expr("doc_id * 43 % 60")  # the inverse of 7 modulo 60
    docs.repartitionByRange(6, place).sortWithinPartitions(place).write.parquet(f"{tmp_path}/mixed")
    read = spark.read.parquet(f"{tmp_path}/mixed")
    assert len(read.inputFiles()) > 1
    want = [i for i, *_ in rows]
    assert [r.doc_id for r in read.collect()] != want
    assert [r.doc_id for r in corpus_pipeline.tokens(spark, read, D).orderBy("place").collect()] == want


def test_a_run_is_in_training_order(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert [r.place for r in out] == sorted(r.place for r in out) and len({r.place for r in out}) == len(out)
