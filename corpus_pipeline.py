"""The corpus pipeline: from raw ``documents`` to token ids with their place in training.

STAGES lists (name, function); every function takes (spark, docs, sf_dir) and works on all its predecessor kept. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from envlattice.llm import bpe, mixing, quality, secrets, simhash
from envlattice.llm.common import fresh_path, table
from envlattice.llm.queries import TOKENIZERS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the hard rules and that the votes find good.

    Null and empty texts have no words and go; long ones are counted whole; repeated rows are judged alike, whatever their ids;
    columns of any name stay as they are; an empty table gives an empty one.
    """
    return quality.judge(docs).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8.

    The one of the smallest id stays, of rows without an id one; a row that occurs again stays once. Null and empty texts are
    copies of each other; rows that share an id but not the text are documents like any others; long texts are taken whole;
    columns of any name stay as they are; an empty table gives an empty one.
    """
    return simhash.deduplicate(docs, shingle_words=5, similarity=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; where a length in characters is given, that of the masked text.

    Null texts stay null, with a null length; empty ones stay empty; whole texts are scanned, of any length; all rows stay,
    repeated ones and those of null ids too, with columns of any name; an empty table gives an empty one.
    """
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the weight schedules take, a row for each time that a document is due, in order of training position.

    A null source is a source of its own, the last; null and empty texts have no words and are never due; a long one is
    given whole; repeated rows and those of null ids are due each on their own; columns of any name stay as they are; an
    empty table gives an empty one.
    """
    return mixing.mix(mixing.plan(docs)).select("row.*")


def written_place(docs: DataFrame) -> Column:
    """A number that grows in the order in which the files of ``docs`` were written; what is no bare table counts its rows.

    Spark reads files by descending size. A sorted table's parts are numbered in its order, and rows inside by theirs.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return F.monotonically_increasing_id()
    part = F.coalesce(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long"), F.lit(0))
    return F.shiftleft(part, 40) + F.col("_metadata.row_index")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, place): the whole texts' ids as little-endian unsigned 32-bit integers.

    ``place`` grows in the order of ``docs``, which is that of training. Null and empty texts have no ids; every row comes
    back, repeated ones and those of null ids too; an empty table gives an empty one.
    """
    rows = docs.select(F.struct("doc_id", written_place(docs).alias("place")).alias("row"), "text")
    encoded = bpe.encode(rows, f"{TOKENIZERS}/byte_bpe_50k.json", id_col="row")
    return encoded.select("id.doc_id", "n_tokens", "ids", "id.place")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", tokens),
]

#: SQL can express neither the votes' model nor the fingerprints, the forest or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's result is written as Parquet and read as the next one's input.

    The rows come in training order.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs.orderBy("place")
