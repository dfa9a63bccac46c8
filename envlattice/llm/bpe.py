"""Byte-level BPE: encoding by a priority queue of merge ranks, decoding by vocabulary strings."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import returning

#: Encoded pieces of a generation; a task remembers two. Frequent pieces move on to the new one, others go.
REMEMBERED = 1 << 17
#: Rows that are turned into Python objects and given out at once.
SLICE = 500

# The pattern by which byte-level vocabularies of this kind cut text into pieces, and the code points that
# this regex library takes for letters or numbers and the tokenizer library, of an earlier Unicode version, does not.
PATTERN = r"""'(?:[stmd]|re|ve|ll)| ?{L}++| ?{N}++| ?[^\s{L}{N}]++|\s+(?!\S)|\s+"""
LATER = (
    "\\u0558 \\u058b-\\u058c \\u088f \\u0c5c \\u0cdc \\u208f \\u209d-\\u209f \\ua7ce-\\ua7cf \\ua7d2 \\ua7d4 \\ua7dd "
    "\\ua7e2 \\ua7f1 \\uab6c-\\uab6d \\U000107bb-\\U000107bf \\U00010940-\\U00010959 \\U00010ec5-\\U00010ec7 "
    "\\U00010ed9-\\U00010eee \\U00011b0a \\U00011db0-\\U00011ddb \\U00011de0-\\U00011de9 \\U00011df1 \\U0001246f "
    "\\U00012475-\\U0001247f \\U00012550-\\U00012686 \\U00016ea0-\\U00016eb8 \\U00016ebb-\\U00016ed3 "
    "\\U00016ff2-\\U00016ff6 \\U000187f8-\\U000187ff \\U00018cd6-\\U00018cda \\U00018d09-\\U00018d20 "
    "\\U00018d80-\\U00018df2 \\U00018e00-\\U00019191 \\U000191a0-\\U000191d2 \\U0001b123-\\U0001b128 \\U0001b168 "
    "\\U0001d6a6 \\U0001df1f-\\U0001df24 \\U0001df2b-\\U0001df81 \\U0001df90-\\U0001df96 \\U0001dfcd-\\U0001dfff "
    "\\U0001e6c0-\\U0001e6de \\U0001e6e0-\\U0001e6e2 \\U0001e6e4-\\U0001e6e5 \\U0001e6e7-\\U0001e6ed "
    "\\U0001e6f0-\\U0001e6f4 \\U0001e6fe-\\U0001e6ff \\U0002b73a-\\U0002b73f \\U0002b81e \\U0002cea2-\\U0002cead "
    "\\U000323b0-\\U00033479 \\U0003d000-\\U0003fc3f"
)


#: Texts of these alone, Latin letters and ASCII, are cut alike by a pattern of classes, in a fifth of the time.
LATIN, BLANK = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"\t\n\x0b\x0c\r "
_is_latin = re.compile(rf"[\x00-\x7f{LATIN}]*").fullmatch
_latin = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LATIN}]++| ?[0-9]++| ?[^{BLANK}{LATIN}0-9]++|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+").findall


def _pattern() -> regex.Pattern:
    known = LATER.replace(" ", "")
    out = PATTERN.replace(r"[^\s{L}{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{known}])")
    for kind in "LN":
        out = out.replace(f"{{{kind}}}", rf"[\p{{{kind}}}--[{known}]]")
    return regex.compile(out, regex.V1)


_any = _pattern().findall


def pieces(text: str) -> list[str]:
    """The pieces that are merged each on its own; none is lost."""
    return _latin(text) if _is_latin(text) else _any(text)


def _byte_letters() -> dict[str, int]:
    """Letters by which vocabulary files spell bytes: printable Latin-1 stands for itself, the rest follows from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    """A byte-level vocabulary with its merges, from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: list[bytes] = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for token, i in vocab.items():
            self.strings[i] = bytes(letters[c] for c in token)
        for token, i in added.items():
            self.strings[i] = token.encode()
        self.byte_ids = [0] * 256
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[left] << 32 | vocab[right]] = rank
            self.merged.append(vocab[left + right])
        self.added = {t: array("I", [i]).tobytes() for t, i in added.items()}
        longest_first = sorted(map(regex.escape, added), key=len, reverse=True)
        self.cut = regex.compile(f"({'|'.join(longest_first)})") if added else None
        self.forget()

    def forget(self) -> None:
        """Drops the pieces that are remembered."""
        self.known = _Known(self, {})

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a piece: the queue gives the lowest rank, leftmost first; entries whose pair is gone are skipped."""
        ids = [self.byte_ids[b] for b in piece]
        n, ranks, heap = len(ids), self.ranks, []
        for i in range(n - 1):
            rank = ranks.get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                heap.append(rank << 32 | i)
        if not heap:
            return ids
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            left, j = ids[i], after[i]
            if left < 0 or j >= n or ranks.get(left << 32 | ids[j]) != entry >> 32:
                continue
            ids[i], ids[j], k = self.merged[entry >> 32], -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                rank = ranks.get(ids[i] << 32 | ids[k])
                if rank is not None:
                    heappush(heap, rank << 32 | i)
            if (h := before[i]) >= 0:
                rank = ranks.get(ids[h] << 32 | ids[i])
                if rank is not None:
                    heappush(heap, rank << 32 | h)
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> bytes:
        if len(self.known) > REMEMBERED:
            self.known = _Known(self, dict(self.known))
        return b"".join(map(self.known.__getitem__, pieces(text)))

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers; added tokens in the text are cut out first."""
        if not self.cut or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(self.added.get(part) or self._plain(part) for part in self.cut.split(text))

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids: their vocabulary strings in a row. Unknown ids are skipped, and what is not UTF-8 replaced."""
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and numbers.max() >= len(self.strings):
            numbers = numbers[numbers < len(self.strings)]
        out = b"".join(map(self.strings.__getitem__, numbers.tolist()))
        try:
            out.decode()
        except UnicodeDecodeError:
            out = out.decode(errors="replace").encode()
        return out


class _Known(dict):
    """Ids of pieces, merged where they are missing; those of the generation before are taken over when asked for."""

    def __init__(self, bpe: Bpe, older: dict[str, bytes]):
        super().__init__()
        self.merge, self.older = bpe.merge, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("I", self.merge(piece.encode())).tobytes()
        if len(piece) <= 64:  # long ones are rare, and would make the memory of pieces unbounded
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _map(docs: DataFrame, vocabulary: str, id_col: str, col: str, kind: str, schema: str, row: Callable) -> DataFrame:
    """(id, ...) by ``row``, which gets a task's ``Bpe`` and a value; pieces are remembered within a task."""
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            rows = [row(load(vocabulary), v) for v in batch.column(1).to_pylist()]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0)} | dict(zip(names, map(list, columns), strict=True)))

    source = docs.select(F.col(id_col).alias("id"), F.col(col).cast(kind).alias("value"))
    return source.mapInArrow(returning(run, lambda: load(vocabulary).forget()), f"id {source.schema['id'].dataType.simpleString()}, {schema}")


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids binary) per row: the whole text's ids as little-endian unsigned 32-bit integers.

    A null text counts as empty; texts of any length are taken whole; repeated rows and null ids come back as they are, and
    an empty table gives an empty one. No other column is read, whatever its name.
    """

    def row(bpe: Bpe, text: str | None) -> tuple[int, bytes]:
        ids = bpe.encode(text or "")
        return len(ids) // 4, ids

    return _map(docs, vocabulary, id_col, text_col, "string", "n_tokens long, ids binary", row)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text string) per row of ids; null ids count as none."""
    return _map(encoded, vocabulary, id_col, ids_col, "binary", "text string", lambda bpe, ids: (bpe.decode(ids or b"").decode(),))


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass, and keeps digests only.

    Nulls, repeated rows, long texts and an empty table are as for ``encode``.
    """

    def row(bpe: Bpe, text: str | None) -> tuple[int, str, str]:
        ids = bpe.encode(text or "")
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    return _map(docs, vocabulary, id_col, text_col, "string", "n_tokens long, ids_sha256 string, decoded_sha256 string", row)
