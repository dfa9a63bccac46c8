"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs the votes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import returning, written
from .substrings import word_hashes

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
#: Words of a window whose repetition inside a text counts.
REPEAT = 8

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct_words", "n_adjacent_repeats", "n_upper", "n_letters", "n_marks", "n_bars",
]


def repeat_words(hashes: np.ndarray, size: int = REPEAT) -> int:
    """Words covered by windows of ``size`` words that are found twice or more, the first included."""
    n = len(hashes) - size + 1
    if n < 2:
        return 0
    grams = np.zeros(n, np.uint64)
    for j in range(size):
        grams *= np.uint64(0x9E3779B97F4A7C15)
        grams += hashes[j : j + n]
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    places = np.flatnonzero(np.isin(grams, twice))
    return int(np.minimum(np.diff(places, append=places[-1] + size), size).sum())


def counts(text: bytes) -> tuple[int, ...]:
    """The values of ``COUNTS`` for a text in UTF-8, all over the whole text."""
    words = text.split()
    if not words:
        return (0, 0, sum(text.count(c) for c in SYMBOLS), *[0] * (len(COUNTS) - 3))
    hashes = word_hashes(words)
    bytes_ = np.frombuffer(text, np.uint8)
    histogram = np.bincount(bytes_, minlength=256)
    followers = int(histogram[0x80:0xC0].sum())  # bytes that continue a code point
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    upper = int(histogram[0x41:0x5B].sum())
    letters = upper + int(histogram[0x61:0x7B].sum()) + int(histogram[0xC0:].sum())
    return (
        len(words),
        len(text) - followers - int(histogram[list(BLANKS)].sum()),
        int(histogram[list(SYMBOLS)].sum()),
        len(lines) - len(set(lines)),
        repeat_words(hashes),
        len(lines),
        len(np.unique(hashes)),
        int((hashes[1:] == hashes[:-1]).sum()),
        upper,
        letters,
        int(histogram[0x21]),
        words.count(b"|"),
    )


def features(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, quality_counts): a struct of the columns ``keep`` (all by default), and one of the values of ``COUNTS``."""
    keep = docs.columns if keep is None else keep
    row = F.struct(*keep) if keep else F.struct(F.lit(0).alias("none"))
    # a text that is kept travels once
    inside = text_col in keep and docs.schema[text_col].dataType.typeName() == "string"
    rows = docs.select(row.alias("row"), *([] if inside else [F.col(text_col).cast("binary").alias("text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(text_col).cast(pa.binary()) if inside else batch.column(1)
            found = np.array([counts(t.as_py() or b"") for t in texts], np.int64).reshape(-1, len(COUNTS))
            found = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(COUNTS))], COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["row", "quality_counts"])

    kinds = ", ".join(f"{c}: long" for c in COUNTS)
    row = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(returning(run), f"row {row}, quality_counts struct<{kinds}>")


def base_failed(c) -> Column:
    """The two hard rules: under 20 words, or over 30% of the words inside repeated windows."""
    return (c("n_words") < 20) | (100 * c("n_repeat_words") > 30 * c("n_words"))


@dataclass(frozen=True)
class Rule:
    """Votes against a text where ``share`` is beyond ``bad``, for it where it is within ``good``, else abstains."""

    name: str
    part: str
    whole: str
    good: tuple[float, float]
    bad: tuple[float, float]

    def vote(self, c) -> Column:
        share = c(self.part) / F.greatest(c(self.whole), F.lit(1))
        against = (share < self.bad[0]) | (share > self.bad[1])
        return F.when(against, -1).when(share.between(*self.good), 1).otherwise(0).cast("int")


#: No share is within these bounds: the rule votes against or abstains, as the symptom's absence says little.
NEVER = (1.0, 0.0)
#: Shares below the first or above the second bound of ``bad`` are voted against, those within ``good`` for.
RULES = [
    Rule("symbols", "n_symbols", "n_words", (0, 0.02), (-1, 0.1)),
    Rule("letters", "n_letters", "word_chars", (0.93, 1), (0.75, 2)),
    Rule("bars", "n_bars", "n_words", NEVER, (-1, 0.1)),
    Rule("exclamations", "n_marks", "n_words", NEVER, (-1, 0.2)),
    Rule("capitals", "n_upper", "n_letters", NEVER, (-1, 0.3)),
    Rule("word length", "word_chars", "n_words", NEVER, (2.5, 7.0)),
    Rule("distinct words", "n_distinct_words", "n_words", NEVER, (0.3, 2)),
    Rule("repeated lines", "n_dup_lines", "n_lines", NEVER, (-1, 0.5)),
    Rule("repeated windows", "n_repeat_words", "n_words", NEVER, (-1, 0.3)),
    Rule("same word again", "n_adjacent_repeats", "n_words", (0, 0.02), (-1, 0.15)),
]


@dataclass(frozen=True)
class Votes:
    """The log-odds of quality that a vote against, none and one for add, by rule, and the prior's."""

    prior: float
    weights: list[tuple[float, float, float]]

    def log_odds(self, votes: list[Column]) -> Column:
        out = F.lit(self.prior)
        for vote, (against, none, pro) in zip(votes, self.weights, strict=True):
            out = out + F.when(vote < 0, against).when(vote > 0, pro).otherwise(none)
        return out


def fit(patterns: np.ndarray, n: np.ndarray, rounds: int = 300, smooth: float = 1.0) -> Votes:
    """Expectation-maximisation of a two-class model: rules vote independently given the class, with unknown accuracies.

    ``patterns`` are the distinct rows of votes (-1, 0, 1) and ``n`` their numbers of documents. A rule's accuracy is how often
    it votes for, against or not at all in either class, all estimated. Starts from the balance of votes, so that the class
    that votes favour is the good one; nothing else is set. Probabilities are smoothed by pseudo-counts.
    """
    if not len(n):
        return Votes(0.0, [(0.0, 0.0, 0.0)] * patterns.shape[1])
    said = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, rule, vote
    good = 1 / (1 + np.exp(-2.0 * patterns.sum(axis=1)))
    prior = odds = None
    for _ in range(rounds):
        tables = []
        for weight in (n * good, n * (1 - good)):
            t = np.einsum("p,prv->rv", weight, said) + smooth
            tables.append(t / t.sum(axis=1, keepdims=True))
        share = ((n * good).sum() + smooth) / (n.sum() + 2 * smooth)
        prior, odds = float(np.log(share / (1 - share))), np.log(tables[0] / tables[1])
        new = 1 / (1 + np.exp(-np.clip(prior + np.einsum("prv,rv->p", said, odds), -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return Votes(prior, [tuple(map(float, of_rule)) for of_rule in odds])


def judge(
    docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.5, rules: list[Rule] = RULES
) -> DataFrame:
    """(row, quality_counts, quality_votes, quality, base_failed, kept), ``row`` a struct of the columns ``keep``.

    ``quality`` is the posterior probability under the votes' model, which is fitted over all rows: they are counted by
    vote pattern, of which there are at most 3 to the number of rules whatever the input, and only those counts reach the
    driver. Texts are counted once, in a written table. A row is kept if it passes the hard rules and its probability is at
    least ``threshold``. Null and empty texts have no words and fail; texts of any length are counted whole; repeated rows are
    judged alike; columns of any name are only carried along; an empty table gives an empty result. Rows that fail the hard
    rules vote too.
    """
    c = lambda name: F.col(f"quality_counts.{name}")
    voted = written(features(docs, text_col, keep).withColumn("quality_votes", F.array(*(r.vote(c) for r in rules))), "votes")
    rows = voted.groupBy("quality_votes").count().collect()
    patterns = np.array([r["quality_votes"] for r in rows], np.int64).reshape(-1, len(rules))
    order = np.lexsort(patterns.T)
    model = fit(patterns[order], np.array([r["count"] for r in rows], float)[order])
    votes = [F.col("quality_votes")[i] for i in range(len(rules))]
    quality = 1 / (1 + F.exp(-model.log_odds(votes)))
    failed = base_failed(c)
    return voted.withColumns(
        {"quality": quality, "base_failed": failed, "kept": ~failed & (quality >= threshold)}
    )
