"""Removal of long passages that repeat anywhere in the corpus, by suffix automata of reference shards.

Every window of ``window`` words selects one anchor, the k-gram of the least hash in it (the last of equals), so equal
windows select equal anchors and consecutive windows mostly share one. A *segment* is a run of windows of one document
with one anchor, and segments are dealt by anchor. Only anchors that occur again matter. Of those, each distinct
segment's words are fetched once, from one of the texts that hold it, with the number of its occurrences in the corpus.
A reference shard is as many whole anchors as make SHARD words: a suffix automaton is built over its segments, and the
segments are streamed through it for their matching statistics. Where the longest match has ``window`` words or more, the
state that holds the last ``window`` of them is one distinct window, and the numbers of the segments that pass there say
in how many places it starts. Texts are known by 128 bits of their MD5, so equal texts are one, whatever their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Words of an anchor.
GRAM = 8
#: Words of a reference shard, of whole anchors.
SHARD = 1 << 15
#: Distinct segments of an anchor that one shard takes. The exact way for the rest: those of a hotter anchor are dealt window
#: by window, by the hash of all its words, so that equal windows still meet and no automaton is unbounded.
HOT_ANCHOR = 2000
#: A place packs the first window's word and the number of windows.
_RUN = 1 << 32


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of words, from the words' hashes."""
    n = len(hashes) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[j : j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def last_least(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values, the place of the least, the last of equals."""

    def later(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] <= values[a], b, a)

    at, size = np.arange(len(values)), 1
    while size * 2 <= width:
        at = later(at[:-size], at[size:])
        size *= 2
    return later(at[: len(values) - width + 1], at[width - size :]) if size < width else at


def segments(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, content, first window, number of windows) of every segment of a text."""
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    hashes = word_hashes(words)
    k = min(GRAM, window)
    grams = gram_hashes(hashes, k)
    at = last_least(grams, window - k + 1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    run = np.diff(first, append=len(at))
    # The content's hash is a difference of running sums of hashes, each weighed by the place within the segment.
    # Weights are powers of an odd number, so a common factor turns them into places that count from the segment.
    weights = _powers(len(hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(hashes) * weights, dtype=np.uint64)])
    content = (sums[first + run + window - 1] - sums[first]) * _powers_back(len(hashes))[first]
    content ^= run.astype(np.uint64) << np.uint64(56)
    return grams[at[first]].view(np.int64), content.view(np.int64), first, run


_ODD = 0xD6E8FEB86659FD93
_known = {"on": np.ones(1, np.uint64), "back": np.ones(1, np.uint64)}


def _grown(kind: str, factor: int, n: int) -> np.ndarray:
    have = _known[kind]
    if len(have) < n:
        have = np.ones(max(n, 2 * len(have)), np.uint64)
        have[1:] = np.uint64(factor)
        have = _known[kind] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def _powers(n: int) -> np.ndarray:
    return _grown("on", _ODD, n)


def _powers_back(n: int) -> np.ndarray:
    return _grown("back", pow(_ODD, -1, 1 << 64), n)


def _mixed(hashes: np.ndarray) -> np.ndarray:
    out = hashes * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


class SuffixAutomaton:
    """All substrings of the texts put in, over words as symbols."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            if (q := nxt[last].get(w)) is not None:  # known from an earlier text
                last = q if length[q] == length[last] + 1 else self._clone(last, w, q)
                continue
            new = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = new

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def windows(self, words: list, size: int) -> list[int]:
        """For every window of ``size`` words of a text the state that holds it, or -1 if no text put in has it.

        ``n`` is the matching statistic: the words of the longest match that ends here, in state ``v``.
        """
        nxt, link, length = self.next, self.link, self.length
        out, v, n = [], 0, 0
        for i, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            v = nxt[v].get(w, 0)
            n = n + 1 if v else 0
            if n >= size:
                while length[link[v]] >= size:
                    v = link[v]
                n = min(n, length[v])
            if i >= size - 1:
                out.append(v if n >= size else -1)
        return out


def repeated(texts: list[bytes], counts: list[int], window: int) -> list[list[tuple[int, int]]]:
    """For each distinct text with its number of occurrences, the runs (first, end) of windows found twice or more."""
    automaton = SuffixAutomaton()
    split = [t.split() for t in texts]
    for words in split:
        automaton.add(words)
    states = [automaton.windows(words, window) for words in split]
    total = dict.fromkeys((s for each in states for s in each), 0)
    for each, n in zip(states, counts, strict=True):
        for s in each:
            total[s] += n
    out = []
    for each in states:
        runs = []
        for i, s in enumerate(each):
            if total[s] > 1:
                if runs and runs[-1][1] == i:
                    runs[-1] = (runs[-1][0], i + 1)
                else:
                    runs.append((i, i + 1))
        out.append(runs)
    return out


def _batch(names: list[str], kinds: list, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _segments_of(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[np.ndarray]] = [[], [], [], [], []]
            for t0, t1, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                anchor, content, first, run = segments(text.split(), window)
                n = len(anchor)
                for column, x in zip(found, (anchor, content, np.full(n, t0), np.full(n, t1), first * _RUN + run), strict=True):
                    column.append(x)
            columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]
            yield _batch(["anchor", "content", "t0", "t1", "place"], [pa.int64()] * 5, columns)

    return run


def _fetch(window: int):
    """Words of the wanted segments of each text: (key, anchor, content, offset, n, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.split()
                for want in wanted:
                    first, run = divmod(want["place"], _RUN)
                    if want["hot"]:
                        pieces = [(j, b" ".join(words[first + j : first + j + window])) for j in range(run)]
                        keyed = [(xxhash.xxh3_64_intdigest(p) - (1 << 63), j, p) for j, p in pieces]
                    else:
                        keyed = [(want["anchor"], 0, b" ".join(words[first : first + run + window - 1]))]
                    for key, j, piece in keyed:
                        for column, x in zip(out, (key, want["anchor"], want["content"], j, want["n"], piece), strict=True):
                            column.append(x)
            yield _batch(["key", "anchor", "content", "offset", "n", "words"], [*[pa.int64()] * 5, pa.binary()], out)

    return run


def _judge(window: int):
    """Rows of _fetch, in order of key -> (anchor, content, runs of repeated windows), a shard at a time."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        key, own, size = None, [], 0
        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key and size >= SHARD:
                    yield own
                    own, size = [], 0
                key = k
                own.append(row)
                size += row[-1].count(b" ") + 1
        if own:
            yield own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["anchor", "content", "first", "end"], [pa.int64()] * 4
        for own in shards(batches):
            texts: dict[bytes, int] = {}
            for *_, n, words in own:
                texts[words] = texts.get(words, 0) + n
            found = dict(zip(texts, repeated(list(texts), list(texts.values()), window), strict=True))
            out: list[list[int]] = [[], [], [], []]
            for anchor, content, offset, _, words in own:
                for a, b in found[words]:
                    for column, x in zip(out, (anchor, content, a + offset, b + offset), strict=True):
                        column.append(x)
            yield _batch(names, kinds, out)

    return run


def _name(text: Column) -> list[Column]:
    """The 128 bits that name a text, in two longs."""
    digest = F.md5(text)
    return [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("long").alias(f"t{i}") for i in range(2)]


def spans(docs: DataFrame, window: int = 35, text_col: str = "text") -> DataFrame:
    """(t0, t1, spans) for the texts that have repeated windows: sorted (first word, end) of the words they cover."""
    if window < 2:
        raise ValueError("a window has two words or more")
    text = F.col(text_col).cast("binary")
    kept = docs.where(F.length(text) >= 2 * window - 1).select(*_name(text), text.alias("text"))
    every = written(
        kept.mapInArrow(_segments_of(window), "anchor long, content long, t0 long, t1 long, place long"), "segments"
    )
    # the join's key is not the one that was counted by, so both sides are dealt for it and Spark can split a hot anchor
    again = every.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select(F.bitwise_not("anchor").alias("not_anchor"))
    wanted = written(every.join(again, F.bitwise_not("anchor") == F.col("not_anchor"), "left_semi"), "wanted")
    forget(every)
    distinct = wanted.groupBy("anchor", "content").agg(
        F.count("*").alias("n"), F.min(F.struct("t0", "t1", "place")).alias("at")
    )
    distinct = written(distinct.select("anchor", "content", "n", "at.*"), "distinct")
    hot = distinct.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > HOT_ANCHOR)
    hot = hot.select(F.bitwise_not("anchor").alias("not_anchor"), F.lit(True).alias("hot"))
    # a list has at most the segments of one text
    lists = (
        distinct.join(hot, F.bitwise_not("anchor") == F.col("not_anchor"), "left")
        .groupBy("t0", "t1")
        .agg(F.collect_list(F.struct("anchor", "content", "n", "place", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
    )
    shards = (
        kept.dropDuplicates(["t0", "t1"])
        .join(lists, ["t0", "t1"])
        .select("text", "wanted")
        .mapInArrow(_fetch(window), "key long, anchor long, content long, offset long, n long, words binary")
    )
    judged = written(
        shards.repartition("key").sortWithinPartitions("key").mapInArrow(_judge(window), "anchor long, content long, first long, end long"),
        "judged",
    )
    forget(distinct)
    found = wanted.join(judged, ["anchor", "content"])
    start = F.shiftright("place", 32)
    covered = F.struct((start + F.col("first")).alias("first"), (start + F.col("end") + (window - 1)).alias("end"))
    # a set, so that equal texts are one before anything is shuffled
    return found.groupBy("t0", "t1").agg(F.array_sort(F.collect_set(covered)).alias("spans"))


def _cut():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                kept, at = [], 0
                for span in found or ():
                    kept += words[at : max(at, span["first"])]
                    at = max(at, span["end"])
                kept += words[at:]
                out[0].append(len(words))
                out[1].append(len(words) - len(kept))
                out[2].append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())],
                ["id", "n_words", "n_removed", "kept"],
            )

    return run


def remove_repeated(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words long, n_removed long, kept binary) for every row: the words that no repeated window covers.

    A window is repeated if its words also start anywhere else in the table, the same text included; all are judged on
    the input. ``kept`` is UTF-8, words joined by single spaces. A null text has no words; rows that occur again repeat
    each other; ids are only carried along, so null and shared ones are as good as any. Texts of any length are taken whole,
    an empty table gives an empty result, and no other column is read.
    """
    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), *_name(text))
    joined = rows.join(spans(docs, window, text_col), ["t0", "t1"], "left").select("id", "text", "spans")
    kind = joined.schema["id"].dataType.simpleString()
    return joined.mapInArrow(_cut(), f"id {kind}, n_words long, n_removed long, kept binary")


def digest(kept: DataFrame) -> DataFrame:
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
