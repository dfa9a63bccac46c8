"""Word-piece counts by a linear longest-match automaton: no piece is ever built."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _byte_letters

#: Words whose counts a Python worker remembers; beyond that it forgets them all and starts again.
REMEMBERED = 1 << 20
#: Pieces of a word that the vocabulary cannot spell: one unknown token for the whole word.
UNKNOWN = 1


class LongestMatch:
    """Greedy longest-match lengths over two vocabularies: pieces that start a word, and pieces that go on.

    A trie holds both, with one root each. Where the scan cannot go on from a node, the greedy tokenizer would cut
    there: it takes the longest pieces that start the text on the path, and is left with a suffix of it, to be continued
    as a prefix of further pieces. ``popped`` is the number of pieces cut so and ``fail`` the node of that suffix, both
    computed once a node, so that a word is counted in time linear in its length.
    """

    def __init__(self, starts: list[bytes], suffixes: list[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        self.fail = [-1, -1]
        self.popped = [0, 0]
        piece = [False, False]
        for root, vocabulary in ((0, starts), (1, suffixes)):
            for token in vocabulary:
                node = root
                for b in token:
                    after = self.next[node].get(b)
                    if after is None:
                        after = self.next[node][b] = len(self.next)
                        self.next.append({})
                        self.fail.append(-1)
                        self.popped.append(0)
                        piece.append(False)
                    node = after
                if token:
                    piece[node] = True
        todo = deque([0, 1])
        while todo:  # in order of depth, so that every failure link leads to a node that is done
            node = todo.popleft()
            for b, child in self.next[node].items():
                todo.append(child)
                if piece[child]:
                    self.fail[child], self.popped[child] = 1, 1
                    continue
                at, n = self.fail[node], self.popped[node]
                while at >= 0 and b not in self.next[at]:
                    n += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[child], self.popped[child] = self.next[at][b], n

    def count(self, word: bytes) -> int:
        """Number of pieces of a word; UNKNOWN if a part of it starts no piece."""
        nxt, fail, popped = self.next, self.fail, self.popped
        node, n = 0, 0
        for b in word:
            while (after := nxt[node].get(b)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return UNKNOWN
            node = after
        while node > 1:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return UNKNOWN
        return n


class _Counts(dict):
    """Counts of words, computed where they are missing."""

    def __init__(self, match: LongestMatch):
        super().__init__()
        self.match = match

    def __missing__(self, word: bytes) -> int:
        n = self.match.count(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def read_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """(pieces that start a word, pieces that go on) of a byte-level vocabulary file: the former are spelt with a blank."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    letters = _byte_letters()
    tokens = [bytes(letters[c] for c in token) for token in vocab]
    return [t[1:] for t in tokens if t[:1] == b" " and len(t) > 1], [t for t in tokens if t[:1] != b" "]


@lru_cache(maxsize=2)
def load(path: str) -> _Counts:
    starts, suffixes = read_vocabulary(path)
    # a word none of whose prefixes starts a word still has its bytes: they may start one, as they may go on
    return _Counts(LongestMatch([*starts, *(t for t in suffixes if len(t) == 1)], suffixes))


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words long, n_tokens long, longest long) of every row: words, their pieces, and most pieces of a word.

    Words are cut by the six ASCII blanks, over the whole text. A null text has none; rows that occur again and null ids
    are counted like any other; an empty table gives an empty result, and no other column is read. What a worker remembers is
    bounded, whatever the number of different words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = load(vocabulary)
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = (text or b"").split()
                if words:
                    pieces = list(map(counts.__getitem__, words))
                    out[:, i] = len(words), sum(pieces), max(pieces)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, out)], ["id", "n_words", "n_tokens", "longest"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_tokens long, longest long")
