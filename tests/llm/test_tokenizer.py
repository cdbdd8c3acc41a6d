"""Encoding against the public libraries."""

import base64
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quakeweave.llm import tokenizer as K

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return K.load_vocabulary(P.path("byte_bpe_50k.tiktoken"))


def lists(ids, sizes):
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_pattern_is_the_published_one():
    assert K.PATTERN == P.PATTERN


def test_hard_texts(vocabulary, reference):
    r = random.Random(4)
    texts = ["", None, " ", "<|endoftext|> it's we'll", "a" * 4001, "ab" * 999, "-" * 300 + "=" * 77, "🙂" * 50, "aaaaaaab aaa", "\u0000\t\n x", "日本語の文章です。" * 40, "".join(r.choice("abcde") for _ in range(5000)), "".join(chr(r.randrange(97, 123)) for _ in range(8000))]
    assert lists(*K.Encoder(vocabulary).encode(texts)) == [reference.encode_ordinary(t or "") for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=6))
def test_any_text(vocabulary, reference, texts):
    e = K.Encoder(vocabulary, cache_words=20)  # forgets again and again
    for _ in range(2):
        assert lists(*e.encode(texts)) == [reference.encode_ordinary(t) for t in texts]
        assert e.count(texts).tolist() == [len(reference.encode_ordinary(t)) for t in texts]


def test_spark(spark, vocabulary, reference):
    rows = [(1, "The quick fox", "x"), (1, "The quick fox", "x"), (None, "", "y"), (3, None, "z"), (4, "word " * 60_000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in K.encode_texts(df, "doc_id", "text").collect()]
    want = [(k, reference.encode_ordinary(t or "")) for k, t, _ in rows]
    key = lambda p: (p[0] is None, p[0] or 0, len(p[1]))
    assert sorted(got, key=key) == sorted(want, key=key)
    counts = [r["n_tokens"] for r in K.count_tokens(df, "doc_id", "text").collect()]
    assert sorted(counts) == sorted(len(w) for _, w in want)
    assert K.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_whole_table(spark, small, reference):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in K.encode_texts(docs, "doc_id", "text").collect()}
    assert got == {r["doc_id"]: reference.encode_ordinary(r["text"] or "") for r in docs.select("doc_id", "text").collect()}
