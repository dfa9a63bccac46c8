"""URL rules by cascades of Bloom filters: exact membership over a corpus's keys, without joins."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Bits of one filter at most, as it is sent to the executors with the plan. A filter's size follows the list it encodes, about
#: 1.44 bits a key and halving of its false positives. A list that needs more is encoded in parts, dealt by the keys' hash.
MAX_BITS = 1 << 25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bits_needed(n: int, false_positives: float) -> float:
    return n * max(1.0, math.log2(1 / false_positives)) / math.log(2)


def first_rate(n: int, universe_size: int) -> float:
    """The first filter's rate of false positives, by which about as many of the universe get by as are listed."""
    return min(0.5, max(1e-18, n * math.sqrt(0.5) / max(1, universe_size)))


def in_part(key: Column, i: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts).cast("long")) == i if parts > 1 else F.lit(True)


@dataclass(frozen=True)
class Bloom:
    """A Bloom filter as an array of 64-bit words; ``level`` seeds its hashes."""

    words: tuple[int, ...]
    hashes: int
    level: int

    def _places(self, key: Column) -> list[Column]:
        bits = len(self.words) * 64
        return [F.pmod(F.xxhash64(key, F.lit(self.level * 1000 + i)), F.lit(bits).cast("long")) for i in range(self.hashes)]

    def might_hold(self, key: Column) -> Column:
        # a literal in one piece: folded once, whatever its size
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        out = F.lit(True)
        for place in self._places(key):
            word = F.get(words, F.shiftright(place, 6).cast("int"))
            out = out & (F.getbit(word, place.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1)
        return out

    @staticmethod
    def of(keys: DataFrame, n: int, false_positives: float, level: int) -> Bloom:
        """Encodes the column ``key`` of ``n`` rows: bits are set on the executors, words gathered on the driver."""
        each = max(1.0, math.log2(1 / false_positives))
        n_words = max(1, math.ceil(bits_needed(n, false_positives) / 64))
        empty = Bloom((0,) * n_words, max(1, round(each)), level)
        place = F.explode(F.array(*empty._places(F.col("key"))))
        bits = keys.select(place.alias("place")).select(
            F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit")
        )
        words = [0] * n_words
        for r in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
            words[r["word"]] = r["bits"]
        return Bloom(tuple(words), empty.hashes, level)


@dataclass(frozen=True)
class Cascade:
    """Filters that encode, in turns, listed keys and false positives: exact for every key of the universe."""

    levels: tuple[Bloom, ...]

    def holds(self, key: Column) -> Column:
        # a key that a filter lacks is not listed if the filter encodes listed keys, and listed if it encodes the others
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            inside = self.levels[i].might_hold(key)
            out = (inside & out) if i % 2 == 0 else (~inside | out)
        return out

    @staticmethod
    def of(listed: DataFrame, universe: DataFrame, universe_size: int, max_levels: int = 40) -> Cascade:
        """``listed`` and ``universe`` have a column ``key``; of the universe only what the first filter lets by is kept.

        That is read once and written, about as many keys as are listed; every further level halves what is left, so the
        cascade's size follows the list and not the corpus.
        """
        inside = written(listed.select("key").where("key is not null").distinct(), "listed")
        n = inside.count()
        if not n:
            return Cascade(())
        levels = [Bloom.of(inside, n, first_rate(n, universe_size), 0)]
        by = universe.select("key").where(levels[0].might_hold(F.col("key"))).distinct()
        outside = written(by.join(inside, "key", "left_anti"), "outside")
        sides = [outside, inside]  # by level: the keys that got by the one before and should not have
        while True:
            wrong = sides[(len(levels) - 1) % 2]
            n = wrong.count()
            if not n:
                forget(outside)
                forget(inside)
                return Cascade(tuple(levels))
            if len(levels) == max_levels:
                raise RuntimeError("the cascade does not end")
            levels.append(Bloom.of(wrong, n, 0.5, len(levels)))
            other = len(levels) % 2  # of the other side, those that this filter lets by are the next wrong ones
            sides[1 - other] = sides[1 - other].where(levels[-1].might_hold(F.col("key")))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if null or without ``://``."""
    at = F.locate("://", url)
    host = F.regexp_extract(F.substr(url, at + 3), "^[^/?#]*", 0)
    return F.coalesce(F.when(at > 0, F.translate(host, UPPER, LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.regexp_extract(F.substr(url, at + 3), "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.when(at > 0, rest), F.lit(""))


def _until(text: Column, mark: str, n: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(mark), n)


def candidates(host: Column, path: Column, max_labels: int, max_slashes: int) -> Column:
    """All keys that could be listed: the host's ends of up to so many labels, with the path's beginnings up to a slash.

    The bounds are those of the list, so nothing that is listed is missed, and a URL of any length has a bounded number.
    """
    count = F.size(F.split(host, r"\."))
    ends = F.transform(
        F.sequence(F.lit(1), F.least(count, F.lit(max_labels))), lambda i: _until(host, ".", -i)
    )
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    starts = F.when(
        slashes > 0,
        F.transform(
            F.sequence(F.lit(1), F.least(slashes, F.lit(max_slashes))),
            lambda j: F.concat(_until(path, "/", j), F.lit("/")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.flatten(
        F.transform(ends, lambda h: F.transform(starts, lambda p: F.struct(h.alias("host"), p.alias("path"))))
    )


def _best(found: Column, mine: Callable[[Column], Column], listed: Cascade, blocks: Cascade) -> Column:
    """Of the candidates that are listed the longest, of equals the one with the longer host, with its verdict."""

    def of(c: Column) -> Column:
        key = F.concat(c["host"], c["path"])
        return F.struct(
            (F.length(c["host"]) + F.length(c["path"])).alias("n"), F.length(c["host"]).alias("h"), key.alias("rule"),
            F.when(blocks.holds(key), "block").otherwise("allow").alias("verdict"),
        )

    def hit(c: Column) -> Column:
        key = F.concat(c["host"], c["path"])
        return mine(key) & listed.holds(key)

    return F.array_max(F.transform(F.filter(found, hit), of))


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """The columns of ``urls`` in a struct ``row``, with host, path, rule and verdict.

    ``rules`` has ``rule``, a host and a path that ends in a slash, like ``example.com/de/``, and ``verdict``, block or
    allow. A rule fits its host and all below it, if the path starts with the rule's. The longest that fits wins, of equals
    the one with the longer host; where none fits the URL is on no list, and allowed. A rule that both blocks and allows
    blocks. Null URLs, and those without ``://``, have empty parts and fit no rule. Repeated rows and null ids come back as
    they are, with columns of any name; a URL of any length is judged whole; an empty table gives an empty result.

    A list of any size is encoded: one whose filter would be over MAX_BITS in parts, by the keys' hash. The URLs are then judged
    by one part after the other, and what is found so far is written between them, so that a plan holds one part's filters.
    """
    bad = rules.where(F.col("rule").isNull() | ~F.col("rule").rlike(r"^[^/]+/(.*/)?\z") | ~F.col("verdict").isin("block", "allow"))
    if not bad.isEmpty():
        raise ValueError("a rule is a host and a path that ends in a slash, and blocks or allows")
    key = F.concat(F.col("c.host"), F.col("c.path"))
    most = rules.agg(
        F.max(F.size(F.split(F.substring_index("rule", "/", 1), r"\."))),
        F.max(F.length("rule") - F.length(F.replace(F.col("rule"), F.lit("/"), F.lit("")))),
        F.count_distinct("rule"),
    ).first()
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    parts = urls.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    if most[0] is None:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    found = candidates(F.col("host"), F.col("path"), *most[:2])
    universe = parts.drop("row").select(F.explode(found).alias("c")).select(key.alias("key"))
    size = parts.drop("row").agg(F.sum(F.size(found))).first()[0] or 0
    n_parts = math.ceil(bits_needed(most[2], first_rate(most[2], size)) / MAX_BITS)
    out = parts.withColumn("best", F.lit(None).cast("struct<n:int,h:int,rule:string,verdict:string>"))
    for i in range(n_parts):
        mine = partial(in_part, i=i, parts=n_parts)
        own = rules.select(F.col("rule").alias("key"), "verdict").where(mine(F.col("rule")))
        listed = Cascade.of(own, universe.where(mine(F.col("key"))), -(-size // n_parts))
        blocks = Cascade.of(own.where("verdict = 'block'"), own, most[2] // n_parts)
        out = out.withColumn("best", F.greatest("best", _best(found, mine, listed, blocks)))
        if i + 1 < n_parts:
            out = written(out, "judged")
    return out.select("row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
