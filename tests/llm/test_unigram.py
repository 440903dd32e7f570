import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from tidemark.llm import unigram

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(vocab, unk, byte_fallback):
    t = Tokenizer(models.Unigram(list(vocab), unk_id=unk, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=unigram.SPACE, prepend_scheme="always")
    return t


@pytest.fixture(scope="module")
def full():
    return library(unigram.vocabulary(PATH), 0, True), unigram.Counter(unigram.vocabulary(PATH))


@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("the and  ▁\n\tXéß漢𝄞.,0<>x")), max_size=40))
def test_counts_equal_the_library(full, text):
    tokenizer, counter = full
    assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("ab▁", min_size=1, max_size=4), st.integers(-6, -1), min_size=1, max_size=12), st.text("abc ", max_size=25))
def test_ties(pieces, text):
    """Whole-number scores tie all the time; unknown runs are fused without byte pieces."""
    vocab = [("<unk>", 0.0), *((p, float(s)) for p, s in pieces.items())]
    want = len(library(vocab, 0, False).encode(text, add_special_tokens=False).ids)
    assert unigram.Counter(vocab, byte_fallback=False).count(text) == want


def test_whole_table(spark, sf, full):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in unigram.op6_token_counts(spark, sf).collect()}
    assert got == {d: len(full[0].encode(t or "", add_special_tokens=False).ids) for d, t in docs.items()}


def test_awkward_rows(spark, full):
    rows = [(1, None, 5), (None, "", 6), (1, "x" * 100000, 7), (1, "same words", 8), (1, "same words", 8)]
    got = unigram.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH)
    want = [(d, len(full[0].encode(t or "", add_special_tokens=False).ids)) for d, t, _ in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert unigram.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
