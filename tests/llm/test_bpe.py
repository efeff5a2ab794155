import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

from strataline.llm import bpe as B

from .helpers import DATA, clashing, empty, odd_documents

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.mark.parametrize(("leaf", "window"), [(2, 1), (5, 1), (16, 3)])
def test_tree_equals_plain_encoding(ranks, leaf, window):
    codec = B.Codec(ranks, P.PATTERN, leaf, window)
    rng = random.Random(leaf)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'", "é", "1", "!", "日本", "\t", "the", "\r\n", "🙂", "\x1c", "\u00a0", "word "]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        ids = codec.encode(text)
        assert ids.tolist() == codec.encoding.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", [" " * 30000, "a" * 30000, "!" * 30000, "word " * 10000, "\n" * 30000, "é" * 30000])
def test_very_long_texts(ranks, text):
    codec = B.codec(ranks, P.PATTERN)
    assert codec.encode(text).tolist() == codec.encoding.encode_ordinary(text)


def test_query_on_the_driver_tables(spark, ranks):
    """Ids of every document, and most documents go through joins."""
    codec = B.Codec(ranks, P.PATTERN)
    expected, joined = [], 0
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    for r in docs:
        ids = np.array(codec.encoding.encode_ordinary(r.text or ""), "<u4")
        before = codec.joins
        assert codec.encode(r.text or "").tolist() == ids.tolist()
        joined += codec.joins > before
        expected.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, B.op5_byte_bpe(spark, DATA).collect())) == sorted(expected)
    assert joined > 0.7 * len(docs) and codec.joins > 3 * len(docs)


def test_query(spark, ranks):
    docs = odd_documents(spark)
    plain = B.codec(ranks, P.PATTERN).encoding
    got = B.encode_decode(clashing(docs), PATH, P.PATTERN).collect()
    expected = []
    for r in docs.collect():
        ids = np.array(plain.encode_ordinary(r.text or ""), "<u4")
        expected.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert B.encode_decode(empty(spark), PATH, P.PATTERN).count() == 0
    assert B.encode_decode(docs, PATH, P.PATTERN, with_ids=True).where("size(ids) <> n_tokens").count() == 0
