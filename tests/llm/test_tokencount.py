from hypothesis import given, settings
from hypothesis import strategies as st

from envlattice.llm import queries, tokencount

PATH = f"{queries.TOKENIZERS}/byte_bpe_50k.json"


def greedy(word, starts, suffixes):
    n, at = 0, 0
    while at < len(word):
        vocabulary = suffixes if at else starts
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return tokencount.UNKNOWN
        n, at = n + 1, end
    return n


pieces = st.lists(st.text("abc", min_size=1, max_size=4).map(str.encode), max_size=12)


@settings(max_examples=500, deadline=None)
@given(pieces, pieces, st.lists(st.text("abc", max_size=12).map(str.encode), max_size=8))
def test_small_vocabularies(starts, suffixes, words):
    match = tokencount.LongestMatch(starts, suffixes)
    for w in words:
        assert match.count(w) == greedy(w, set(starts), set(suffixes)), w


def test_documents(spark):
    d = "/root/testdata/sf0.01"
    starts, suffixes = map(set, tokencount.read_vocabulary(PATH))
    starts |= {t for t in suffixes if len(t) == 1}
    known = {}
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        words = r.text.encode().split()
        for w in words:
            if w not in known:
                known[w] = greedy(w, starts, suffixes)
        got = [known[w] for w in words]
        want[r.doc_id] = (len(got), sum(got), max(got, default=0))
    assert {r.doc_id: tuple(r)[1:] for r in queries.op3_token_counts(spark, d).collect()} == want


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (None, "the the"), (2, ""), (3, "x" * 100_000), (4, "é\x00 " * 10)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_tokens int")
    out = {r.id: r for r in tokencount.token_counts(docs, PATH).collect()}
    assert out[1].n_tokens == 0 and out[None].n_tokens == 2 and out[3].n_words == 1 and out[4].n_words == 10
    assert tokencount.token_counts(docs.limit(0), PATH).count() == 0
