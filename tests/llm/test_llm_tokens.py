"""Token counts: splices of random texts equal the library on the whole text."""

import random

import pytest
from edge_rows import documents, empty

from llm import token_counts as T

PARTS = ["a", "  ", " \n\n", " 's", "é", "水", "\U0001f642", "<|endoftext|>", "1234", "...", "\t", "abc def", "x" * 50, " " * 40, "'ll", "ñ", "<|endof", "text|>", "\x1c", "\xa0", "　", "\x85"]


@pytest.fixture(scope="module")
def tokenizer():
    return T._open("byte_bpe_50k.json")


def whole(tokenizer, text):
    return len(tokenizer.encode(text, add_special_tokens=False))


def test_pieces_equal_whole_texts(tokenizer):
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 100)))
        for piece in (5, 40):
            assert T.token_totals(tokenizer, [text, ""], piece) == [whole(tokenizer, text), 0], repr(text)


def test_splices_equal_whole_texts(spark, tokenizer):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS + ["the quick "] * 8) for _ in range(rng.randint(0, 400))) if i % 6 else "y" * rng.randint(0, 3000) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk, overlap in ((200, 40), (700, 64)):  # the long words need wider overlaps
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in T.count_tokens(df, chunk=chunk, overlap=overlap).collect()}
        assert got == {i: (len(t.encode()), whole(tokenizer, t)) for i, t in enumerate(texts)}


def test_edge_rows(spark, tokenizer):
    docs = documents(spark)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in T.count_tokens(docs).collect()), key=str)
    assert got == sorted(((r.doc_id, len((r.text or "").encode()), whole(tokenizer, r.text or "")) for r in docs.collect()), key=str)
    assert T.count_tokens(empty(spark)).count() == 0


def test_tokenizers_without_the_proof_are_not_spliced():
    assert T.spliceable("byte_bpe_50k.json")[0] and not T.spliceable("word_bpe_49k.json")[0]
