import random
import zlib
from itertools import groupby

import numpy as np
import pytest

from tokenizers import Tokenizer

from strataline.llm import packing as K

from .helpers import DATA, clashing, empty, odd_documents


@pytest.fixture(scope="module")
def tokenizer():
    with open(K.default_vocabulary(), "rb") as f:
        return K.WordTokenizer(f.read(), limit=500)


LIBRARY = Tokenizer.from_file(K.default_vocabulary())  # as it comes, with all defaults


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_words_equal_the_library(tokenizer):
    rng = random.Random(2)
    parts = [*"abcdefghijklmnopqrstuvwxyzAZ", "'s", "'", "'re", "é", "ß", "İ", "e\u0301", " ", "  ", "\n", "1", "22", "!", "?!", "日本", "\u00a0", "\u3000", "🙂", "\x1c", "\x85", "<|endoftext|>", "ſ", "ª", "²", "\u200b", "\x00", "the", "ing", "-"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(tokenizer.encode(text.encode()), "<u2").tolist() == library(text), text


def test_hilbert_neighbours_are_adjacent():
    for bits, n in ((4, 2), (3, 3), (2, 4)):
        grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * n)).reshape(n, -1).T
        order = np.argsort(K.hilbert(grid, bits))
        assert sorted(K.hilbert(grid, bits).tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


def check(rows, docs, length):
    """Every id of every document is in one piece; sequences are gapless and full but for the last."""
    pieces = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    for s, group in groupby(pieces, key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at == length or s == pieces[-1].sequence_id
    expected, found = [], []
    for r in docs:
        ids = np.array([*library(r.text or ""), 1], "<u4")
        expected.append((r.doc_id, len(ids)))
        by_start = [p for p in rows if p.doc_id == r.doc_id and p.doc_tokens == len(ids)]
        assert any(p.start == 0 for p in by_start)
        for p in by_start:
            if sum(1 for q in docs if q.doc_id == r.doc_id) == 1:
                assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    found = [(r.doc_id, r.doc_tokens) for r in rows if r.start == 0]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert sum(r.length for r in rows) == sum(n for _, n in expected)


@pytest.mark.parametrize("length", [2048, 64])
def test_pieces(spark, length):
    docs = odd_documents(spark, [(20, "hello <|endoftext|> there<|startoftext|>", "en", "s", 1), (21, "<|ENDOFTEXT|> <|other|>", "en", "s", 1)])
    check(K.pack(clashing(docs), K.default_vocabulary(), length).collect(), docs.collect(), length)


def test_added_tokens_are_the_librarys(tokenizer):
    text = "hello <|endoftext|> there"
    assert np.frombuffer(tokenizer.encode(text.encode()), "<u2").tolist() == [3306, 49407, 997] == library(text)


def test_ties_on_the_curve_follow_ids(spark):
    rows = [(i, "the same text here", None, None, None) for i in (5, 3, 9, 1, 7, 3)]
    got = K.pack(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), K.default_vocabulary(), 8).collect()
    check(got, [type("R", (), {"doc_id": i, "text": t}) for i, t, *_ in rows], 8)
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0] == [1, 3, 3, 5, 7, 9]


def test_query_on_the_driver_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = K.op9_packing(spark, DATA).collect()
    check(got, docs, 2048)
    assert {r.padded_length for r in got} <= {2048, *(1 << k for k in range(11))}


def test_empty(spark):
    assert K.pack(empty(spark), K.default_vocabulary()).count() == 0


def test_similar_documents_are_near(spark):
    rows = [(i, ("apple banana " if i % 2 else "stone metal ") * 40, None, None, None) for i in range(40)]
    got = K.pack(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), K.default_vocabulary(), 64).collect()
    order = [r.doc_id % 2 for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert sum(a != b for a, b in zip(order, order[1:])) == 1
