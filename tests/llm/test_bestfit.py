import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenizers import Tokenizer

from strataline.llm import bestfit as B

from .helpers import DATA, clashing, empty, odd_documents

LIBRARY = Tokenizer.from_file(B.default_vocabulary())
PIECE = "doc_id long, text string, lang string, source string, n_chars long"


def greedy(counts, size):
    """Best-fit decreasing, one piece at a time."""
    rooms = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(size - s)
    return rooms


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 25), max_size=14))
@settings(max_examples=200, deadline=None)
def test_classes_are_the_bins_of_best_fit(counts):
    classes = B.best_fit(counts, 40)
    rooms = [40 - B.fill(items) for items, n in classes.items() for _ in range(n)]
    assert sorted(rooms) == sorted(greedy(counts, 40))


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=16))
@settings(max_examples=200, deadline=None)
def test_exchanges_keep_pieces_and_never_add_bins(counts):
    before, after = B.best_fit(counts, 60), B.plan(counts, 60)
    held = Counter()
    for items, n in after.items():
        assert 0 < B.fill(items) <= 60 and n > 0
        for s, k in items:
            held[s] += k * n
    assert held == counts
    squares = [sum(B.fill(i) ** 2 * n for i, n in c.items()) for c in (before, after)]
    assert squares[1] >= squares[0] and sum(after.values()) <= sum(before.values())
    search = B.Search(after, 60)  # nothing is left to exchange
    assert all(search.best(items) is None for items in search.bins)


def test_exchanges_empty_bins():
    rng = random.Random(1)
    counts = Counter(rng.randint(1300, 1500) for _ in range(30_000))
    before, after = sum(B.best_fit(counts, 4096).values()), sum(B.plan(counts, 4096).values())
    assert after < 0.97 * before
    # 3 + 5 and 3 + 5 of 10: an exchange makes 5 + 5 and 3 + 3, which a further 4 fills
    assert sum(B.Search({((5, 1), (3, 1)): 2, ((4, 1),): 1}, 10).run(100).values()) == 2


def check(rows, docs, length):
    at = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert all(n <= length for n in at.values())
    want = Counter()
    for d in docs:
        ids = np.array([*LIBRARY.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        for p in range(0, len(ids), length):
            own = ids[p : p + length]
            want[(d.doc_id, p // length, p, len(own), zlib.crc32(own.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return at


@pytest.mark.parametrize("length", [4096, 64])
def test_pieces(spark, length):
    docs = odd_documents(spark, [(20, "hello <|endoftext|> there", "en", "s", 1)])
    check(B.pack(clashing(docs), B.default_vocabulary(), length).collect(), docs.collect(), length)


def test_query_on_the_driver_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    rows = B.op13_bestfit_packing(spark, DATA).collect()
    at = check(rows, docs, 4096)
    total = sum(r.length for r in rows)
    counts = Counter(r.length for r in rows)
    assert -(-total // 4096) <= len(at) <= len(greedy(counts, 4096))


def test_one_length_for_half_of_the_documents(spark):
    rows = [(i, "word " * (99 if i % 2 else i % 50), None, None, None) for i in range(600)]
    docs = spark.createDataFrame(rows, PIECE).repartition(7)
    check(B.pack(docs, B.default_vocabulary(), 256).collect(), docs.collect(), 256)


def test_sequences_hold_the_ids(spark):
    docs = odd_documents(spark)
    table = B.sequences(docs, B.default_vocabulary(), 128).collect()
    ids = Counter()
    for r in table:
        own = np.frombuffer(bytes(r.ids), "<u4")
        assert len(own) == r.n_tokens <= 128
        ids.update(own.tolist())
    want = Counter()
    for d in docs.collect():
        want.update([*LIBRARY.encode(d.text or "", add_special_tokens=False).ids, 1])
    assert ids == want


def test_empty(spark):
    assert B.pack(empty(spark), B.default_vocabulary()).count() == 0
