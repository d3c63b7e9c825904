import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import token_counts as tc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
COUNTER = tc.counter_of(tc.model_bytes(MODEL))


def size(text):
    return len(LIBRARY.encode(text, num_threads=1))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aeinrst theTHE,.\n\t  ▁é日𝔘́ <s>01-"), max_size=40) | st.text(max_size=30))
def test_every_prefix(text):
    counts = COUNTER.prefixes(text)
    assert list(counts) == [size(text[:i]) for i in range(len(text) + 1)]
    assert COUNTER.count(text) == counts[-1]
    assert size(COUNTER.truncate(text, 3)) <= 3


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "x" * 3000, " " * 700, "internationalisation " * 50, "<s> </s> <unk> <0x0A>", "a" + " " * 33 + "b", "\n \n  \n", "=" * 100 + "-" * 77])
def test_cases(text):
    assert COUNTER.count(text) == size(text)
    assert COUNTER.prefixes(text)[-1] == size(text)


def test_query_matches_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in tc.op10(spark, sf).collect():
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), size(texts[r.doc_id]))
        assert r.over_limit == (r.n_tokens > 4096)


def test_operators_and_edges(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "Hello world, hello", 7), (3, "Hello world, hello", 7), (4, "word " * 30_000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    assert sorted(r.n_tokens for r in tc.count_tokens(docs).collect()) == sorted(size(t or "") for _, t, _ in rows)
    cut = [r.truncated for r in tc.truncate(docs, 3).orderBy("doc_id").collect()]
    assert cut[0] is None and cut[1] == "" and all(size(c or "") <= 3 for c in cut) and cut[2].startswith("Hello world")
    assert [len(r.prefix_tokens) for r in tc.prefix_counts(docs).where("doc_id = 3").collect()] == [19, 19]
    assert tc.count_tokens(docs.limit(0)).count() == 0
    assert tc.pack([3, 4, 5], 9) == [3, 4, 2] and tc.pack([3], 9) == [3] and tc.pack([], 1) == []
