"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hnsw, mixing, quality, secrets, simhash, substrings, tokencount, urlfilter, warc
from .common import fresh_path, n_words, table, written

def _tokenizers() -> str:
    if found := os.environ.get("ENVLATTICE_TOKENIZERS"):
        return found
    from public_tokenizers import path

    return os.path.dirname(path("byte_bpe_50k.json"))


#: The folder of the public tokenizers' vocabulary files, the same on every machine.
TOKENIZERS = _tokenizers()


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of the sources of ``documents`` takes of each document, in order of training position."""
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    planned = mixing.plan(written(sized, "sizes"), size=F.col("size"), keep=[])
    out = planned.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", mixing.position().alias("position")
    )
    return out.orderBy("position", "doc_id")


OP1_SQL = """
WITH sized AS (
  SELECT *, md5(concat_ws('/', doc_id::VARCHAR, '', size::VARCHAR)) AS o
  FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+')), 0)::BIGINT AS size FROM documents)),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM totals),
weighed AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         CASE (rank - 1) % 3 WHEN 0 THEN 4.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE END AS a,
         CASE (rank - 1) % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END AS b,
         source_size * 2.0::DOUBLE AS cap
  FROM ranked),
levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM weighed)::BIGINT
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, a, b, weight,
         least(cap, coalesce((SELECT level FROM levels WHERE cap > level * weight ORDER BY cap / weight, rank LIMIT 1)
                             * weight, cap)) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.a, t.b, t.weight,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.o, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
due AS (
  SELECT *, CASE WHEN target > 0 THEN least(first::DOUBLE / target, 1.0) ELSE 0.0 END * weight AS c FROM placed)
SELECT doc_id, size, source_size, target,
       greatest(0, least(size, floor(target)::BIGINT - first))
       + greatest(0, least(size, floor(target)::BIGINT - source_size - first)) AS taken,
       CASE WHEN c > 0 THEN least(2 * c / (a + sqrt(greatest(a * a + 2 * c * (b - a), 0.0))), 1.0) ELSE 0.0 END
         AS position
FROM due
"""


def op2_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard rules' counts of every text of ``documents``, and the verdict of the voting rules."""
    judged = quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("row.doc_id", *(f"quality_counts.{c}" for c in counts), "base_failed", "kept", "quality")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2 that SQL can express: the hard rules' counts and verdict."""
    found = op2_quality_votes(spark, sf_dir)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+') AS w FROM d),
places AS (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8),
windows AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS words FROM places),
again AS (SELECT r, words FROM windows GROUP BY r, words HAVING count(*) > 1),
covered AS (SELECT DISTINCT r, i + unnest(range(0, 8)) AS i FROM windows SEMI JOIN again USING (r, words)),
repeats AS (SELECT r, count(*) AS n FROM covered GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^ \\t\\n\\v\\f\\r]') GROUP BY r),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
         coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN dup USING (r) LEFT JOIN repeats USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and word pieces of every text of ``documents``."""
    found = tokencount.token_counts(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")
    return found.withColumnRenamed("id", "doc_id")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in all texts of ``documents``: place, fingerprint and score, never the secret itself."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secrets.with_findings(docs).select("row.doc_id", F.explode("findings").alias("f")).where("f.score >= 0.5")
    return found.select(
        "doc_id",
        F.col("f.start").cast("long").alias("start"),
        F.col("f.end").cast("long").alias("end"),
        F.substring(F.sha2("f.candidate", 256), 1, 12).alias("fingerprint"),
        F.round("f.score", 6).alias("score"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents``: 4-word shingles, fingerprints within 4 bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, max_distance=4)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded and decoded again by a byte-level vocabulary."""
    found = bpe.round_trip(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")
    return found.withColumnRenamed("id", "doc_id")


#: Production rules of URLs.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every URL of ``pages``."""
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlfilter.judge(urls, spark.createDataFrame(RULES, "rule string, verdict string"))
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


OP7_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
lowered AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
rules(rule, rule_host, rule_path, says) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fits AS (
  SELECT p.*, rule, says,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC NULLS LAST, length(rule_host) DESC) AS n
  FROM lowered p LEFT JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(says, 'allow') AS verdict FROM fits WHERE n = 1
"""


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors of ``embeddings`` with one label and a cosine of 0.98 or more."""
    found = hnsw.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


OP8_SQL = """
WITH RECURSIVE rows_ AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
sound AS (
  SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM rows_
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM sound a JOIN sound b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reached(r, s) AS (SELECT r, r FROM rows_ UNION SELECT reached.r, links.b FROM reached JOIN links ON reached.s = links.a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.r)::BIGINT AS n_links, min(o.vec_id) AS component_id,
       v.vec_id IS NOT DISTINCT FROM min(o.vec_id) AS kept
FROM rows_ v JOIN reached USING (r) JOIN rows_ o ON o.r = reached.s GROUP BY v.r, v.vec_id
"""


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` without the words of 35-word windows that start elsewhere too."""
    found = substrings.remove_repeated(table(spark, sf_dir, "documents"), window=35)
    return substrings.digest(found).withColumnRenamed("id", "doc_id")


OP9_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+') AS w FROM documents),
places AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
windows AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS words FROM places),
again AS (SELECT words FROM windows GROUP BY words HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + unnest(range(0, 35)) AS i FROM windows SEMI JOIN again USING (words)),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of ``pages``, as read back from the archives they were written to."""
    path = fresh_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path, with_payload=False)
    return found.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT *, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS first FROM p),
fives AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(h, (5 * k + 1)::INT, 5))::BIGINT) AS bits FROM d)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
       list_reduce(list_transform(range(0, 32), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((bits[k // 4 + 1] >> (15 - 5 * (k % 4))::BIGINT) & 31))::INT, 1)),
         lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM fives
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_mixing, op2_quality_votes, quality_counts, op3_token_counts, op4_secrets, op5_simhash, op6_bpe, op7_url_filter, op8_hnsw, op9_substrings, op10_warc,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": OP1_SQL, "quality_counts": QUALITY_SQL, "op7_url_filter": OP7_SQL, "op8_hnsw": OP8_SQL, "op9_substrings": OP9_SQL, "op10_warc": OP10_SQL,
    }
