import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm.encoding import TOKENIZERS, Encoder, encode_corpus

FILE = f"{TOKENIZERS}/byte_bpe_50k.json"
ENC = {n: Encoder(FILE, n) for n in (1, 2, 3, 5, 8, 40)}
PIECES = st.sampled_from(["'", "'s", "'re", "r", "e", "'ll", " ", "  ", "\n", "\n\n", "\t", "a", "ab", "hello", " world", "1", "42", "é", "日本", "👍🏽", "​", "\x00", "\x1f", "\x85", "\xa0", "　", "<|endoftext|>", "!!", ".", "İ", "ﬁ", "é", "हिन्दी"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=40).map("".join))
def test_tree_equals_plain(text):
    want = ENC[40].plain([text])[0]
    for e in ENC.values():
        assert e.encode(text) == want
    assert ENC[40].decode(want) == text


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=120))
def test_any_text(text):
    want = ENC[40].plain([text])[0]
    for e in ENC.values():
        assert e.encode(text) == want


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 9_000, "'" * 5000, "ab 1" * 5000, "\n" * 7000 + "x", ""])
def test_long_runs(text):
    e = Encoder(FILE, 512)
    assert e.encode(text) == e.plain([text])[0]


def test_real_documents():
    e = Encoder(FILE, 64)
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' where text is not null").fetchall()]
    assert e.encode_all(texts) == e.plain(texts)


def test_corpus(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello  world", None), (3, "Hello  world", None)], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode_corpus(df).collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and ENC[40].decode(got[2][1]) == "Hello  world"
    assert encode_corpus(df.limit(0)).count() == 0
