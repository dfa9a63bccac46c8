import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from envlattice.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
THEIRS = Tokenizer.from_file(PATH)
ODD = ["", " ", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "it's we'll I'M", "\x00  ﻿", "é 日本語 🙂🙂", "a" * 3000,
       "1234 ½ Ⅻ ٣", "  \n\n\t tail  ", "don''t 're", " x　y", "\U0001df2b࢏x౜1 \U0003d000!", "<|endoftext|", "ab" * 40 + " " * 99]


def ids_of(text):
    return THEIRS.encode(text, add_special_tokens=False).ids


def mine(text):
    import numpy as np

    return np.frombuffer(bpe.load(PATH).encode(text), "<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert mine(text) == ids_of(text)
    assert bpe.load(PATH).decode(bpe.load(PATH).encode(text)).decode() == THEIRS.decode(ids_of(text), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert mine(text) == ids_of(text)


def test_every_letter_and_number_class():
    pieces = bpe.pieces
    for block in range(0, 0x110000, 256):
        text = "".join(f"a{chr(c)} {chr(c)}1" for c in range(block, block + 256) if not 0xD800 <= c < 0xE000)
        assert pieces(text) == [text[a:b] for _, (a, b) in THEIRS.pre_tokenizer.pre_tokenize_str(text)], hex(block)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {}
    for r in docs.collect():
        ids = ids_of(r.text)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want[r.doc_id] = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(THEIRS.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    found = bpe.round_trip(docs, PATH)
    assert {r.id: tuple(r)[1:] for r in found.collect()} == want
    encoded = bpe.encode(docs, PATH)
    assert {r.id: r.text for r in bpe.decode(encoded, PATH).collect()} == {r.doc_id: r.text for r in docs.collect()}


def test_nulls_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "a", 6)], "doc_id long, text string, n_tokens int")
    assert sorted((r.id or 0, r.n_tokens) for r in bpe.encode(docs, PATH).collect()) == [(0, 1), (1, 0), (1, 0)]
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("ids", [[1, 255], [255, 200, 1], [130], [10**6, 5]])
def test_ids_that_are_not_text(ids):
    packed = b"".join(i.to_bytes(4, "little") for i in ids)
    assert bpe.load(PATH).decode(packed).decode() == THEIRS.decode(ids, skip_special_tokens=False)


def test_a_task_remembers_no_pieces_and_gives_out_bounded_batches(monkeypatch):
    import pyarrow as pa

    from envlattice.llm import common

    class Docs:
        columns = schema = None

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    class Id:
        dataType = type("Long", (), {"simpleString": staticmethod(lambda: "bigint")})  # noqa: N815

    Docs.schema = {"id": Id}
    given_back = []
    monkeypatch.setattr(common, "give_back", lambda: given_back.append(len(bpe.load(PATH).known)))
    monkeypatch.setattr(bpe.F, "col", lambda name: type("C", (), {"alias": lambda s, n: s, "cast": lambda s, t: s})())
    texts = [f"word{i} again {i * 7919}" for i in range(1300)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "value": texts})
    out = list(bpe.encode(Docs(), PATH)(iter([batch])))
    assert max(b.num_rows for b in out) <= 500
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(len(texts)))
    assert [i for b in out for i in b.column(2).to_pylist()] == [bpe.load(PATH).encode(t) for t in texts]
    assert given_back == [0]  # idle workers hold no pieces
