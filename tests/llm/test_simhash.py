import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from strataline.llm import simhash as S
from strataline.llm.graph import components
from strataline.llm.xxh64 import hash_spans

from .helpers import DATA, DOCS, clashing, empty, odd_documents


def fingerprint(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def classes(values, radius):
    """Smallest member of the component of each value."""
    left, out = set(values), {}
    while left:
        queue = [left.pop()]
        group = list(queue)
        while queue:
            x = queue.pop()
            near = [y for y in left if (x ^ y).bit_count() <= radius]
            left.difference_update(near)
            queue += near
            group += near
        for x in group:
            out[x] = frozenset(group)
    return out


def brute(rows):
    fp = [fingerprint(t) for _, t in rows]
    group = classes(fp, 4)
    low = {}
    for (i, _), f in zip(rows, fp, strict=True):
        if i is not None:
            low[group[f]] = min(i, low.get(group[f], i))
    return Counter((i, f"{f:016x}", low.get(group[f])) for (i, _), f in zip(rows, fp, strict=True))


def test_xxh64():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 9000).astype(np.uint8)
    starts = rng.integers(0, 3000, 400)
    ends = starts + np.concatenate([np.arange(100), rng.integers(0, 300, 299), [5000]])
    raw = data.tobytes()
    assert hash_spans(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(starts, ends, strict=True)]


@pytest.mark.parametrize("radius", [2, 4])
def test_masks_cover_every_pair(radius):
    family = S.masks(radius)
    rng = random.Random(radius)
    pairs = combinations(range(64), 2) if radius == 2 else (rng.sample(range(64), 4) for _ in range(3000))
    for bits in pairs:
        x = sum(1 << i for i in bits)
        assert any(not x & m for m in family)


@pytest.mark.parametrize("limit", [8192, 2])
def test_links_match_brute_force(spark, limit):
    """A dense ball of near fingerprints, chains, and far ones; small buckets and the way for large ones."""
    rng = random.Random(limit)
    center = rng.getrandbits(64)
    values = {center ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3))) for _ in range(60)}
    chain = rng.getrandbits(64)
    for _ in range(12):
        chain ^= sum(1 << i for i in rng.sample(range(64), 4))
        values.add(chain)
    values |= {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    nodes = spark.createDataFrame([(S._signed(v),) for v in values], "fp long")
    got = {r.node: r.root for r in components(S.link_nodes(nodes, limit=limit)).collect()}
    expected = classes(values, 4)
    for v in values:
        assert got.get(S._signed(v), S._signed(v)) == min(S._signed(x) for x in expected[v])


def test_long_chain_converges(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 1000), (7, 5)], "u long, v long")
    assert {r.node: r.root for r in components(edges).collect()} == {i: 0 for i in range(1, 301)}
    assert components(edges.limit(0)).count() == 0


def test_documents(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 99)}" for _ in range(120)]
    near = [(100 + k, " ".join(base[:k] + ["changed"] + base[k + 1 :]), "en", "s", 1) for k in range(0, 120, 7)]
    docs = odd_documents(spark, near)
    got = S.near_duplicates(clashing(docs))
    assert Counter(map(tuple, got.collect())) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert S.near_duplicates(empty(spark)).count() == 0


def test_stage_keeps_one_of_each_class(spark):
    docs = clashing(odd_documents(spark))
    kept = S.stage(spark, docs, "")
    assert kept.columns == docs.columns
    group = classes({fingerprint(r.text) for r in docs.collect()}, 4)
    expected = {}
    for r in docs.collect():
        place = (r.doc_id is None, r.doc_id or 0, r.text or "")
        c = group[fingerprint(r.text)]
        expected[c] = min(expected.get(c, place), place)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(p[:2] for p in expected.values())


def test_hot_group_of_copies(spark, monkeypatch):
    rows = [(i, "the very same text here and there" if i % 3 else f"own {i} text " * 9, "en", "s", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    got = S.near_duplicates(docs).collect()
    assert {r.component_id for r in got if r.doc_id % 3} == {1}
    monkeypatch.setattr(S, "COPIES", 100)
    assert Counter(map(tuple, S.near_duplicates(docs).collect())) == Counter(map(tuple, got)) == brute([r[:2] for r in rows])


def test_query_on_the_driver_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert Counter(map(tuple, S.op6_simhash(spark, DATA).collect())) == brute([(r.doc_id, r.text) for r in docs])


def test_empty_stage(spark):
    assert S.stage(spark, empty(spark), "").count() == 0
