import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from darkslide.llm.tokenizer import TOKENIZERS, count_tokens, encoder, tokenise

tokenizers = pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZERS), reason="no vocabulary files")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def same(public, text):
    return encoder().encode(text) == public.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(public, text):
    text = text.encode("utf-8", "ignore").decode()
    assert same(public, text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abeinrst'll ve.!0\n夜é", max_size=120))
def test_text_that_merges(public, text):
    assert same(public, text)


@pytest.mark.parametrize("text", ["a" * 20000, "<|endoftext|> x", " \n\n\t x  ", "0123456789" * 200, "👩‍👩‍👧" * 50, "夜景、" * 300, "\x00\x01"])
def test_odd_texts(public, text):
    assert same(public, text)


def test_long_pieces_are_linear():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(200_000))
    ids = encoder().encode(text)
    assert len(ids) > 1000


def test_every_token_encodes_to_itself(public):
    e = encoder()
    for number in range(256, 50256, 97):
        a, b = e.halves[number]
        assert e.merged[a, b] == number
        assert not e.compatible(a, b)


def test_operators(spark, public):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (3, "", None), (None, "a", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint_ string".replace("n bigint_", "other"))
    got = {r["doc_id"]: r["ids"] for r in tokenise(df).collect()}
    assert got == {1: public.encode("Hello world", add_special_tokens=False).ids, 2: [], 3: [], None: encoder().encode("a")}
    sizes = {r["doc_id"]: r["n_tokens"] for r in count_tokens(df).collect()}
    assert sizes == {1: 2, 2: 0, 3: 0, None: 1}
    assert tokenise(df.limit(0)).count() == 0 and tokenise(df).columns == ["doc_id", "other", "ids"]
    assert tokenise(df.withColumnRenamed("other", "ids")).where("doc_id = 3").first()["ids"] == []
