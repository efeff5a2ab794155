import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from strataline.llm import trie as T

from .helpers import DATA

TURNS = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_scans_are_those_of_whole_numbers():
    rng = np.random.default_rng(1)
    for size in (0, 1, 7, 300):
        conv = np.sort(rng.integers(0, 5, size))
        v = rng.integers(0, T.PRIME, size).astype(np.uint64)
        place, got = T._places(conv), T.roll(v, T._places(conv), T.BASE)
        want, at, last = [], 0, None
        for c, x in zip(conv.tolist(), v.tolist(), strict=True):
            at = (at * T.BASE + x) % T.PRIME if c == last else x
            last = c
            want.append(at)
        assert got.tolist() == want
        sums = defaultdict(int)
        for c, x, s in zip(conv.tolist(), v.tolist(), T.add_up(v, place, 1).tolist(), strict=True):
            sums[c] = (sums[c] + x) % 2**64
            assert s == sums[c]
    e = rng.integers(0, 2**40, 50)
    assert T.powers(T.BASE, e).tolist() == [pow(T.BASE, int(x), T.PRIME) for x in e]


def paths(rows):
    """(role, text) lists of conversations in order."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            out[c].append((t, role or "", text or ""))
    return {c: [x[1:] for x in sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))] for c, own in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:]
    return out


def expected(convs):
    if not convs:
        return set()
    members, out = defaultdict(list), set()
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = own + sum(saved[x] for x in children[node])
    for node, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(node))))
        out.add((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(df):
    rows = [tuple(r[n] for n in NAMES) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def odd_rows(n=90):
    rng = random.Random(6)
    texts, roles = ["a", "b", "", None, "ü", "the same " * 900, "the same " * 900 + "!", "x" * 64, "x" * 64 + "y"], ["user", "assistant", None, ""]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in range(n) for _ in range(rng.randint(1, 7))]
    rows += [(c, t, "user", f"shared {t}") for c in range(200, 230) for t in range(c % 7 + 1)]  # prefixes of each other
    rows += [(c, 0, "user", "first of five is absent") for c in range(401, 440) if c % 5]
    rows += [(300, 1, "user", "again"), (300, 1, "user", "again"), (None, 1, "user", "no id"), (-3, 0, "user", "below zero"), (-5, 0, "user", "shared 0")]
    return rows


@pytest.mark.parametrize("bits", [61, 6, 2])
def test_trie_with_odd_rows_and_collisions(spark, bits):
    rows = odd_rows() if bits == 61 else odd_rows(40)
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], TURNS + ", depth int, fp string").repartition(5)
    assert found(T.prefix_trie(docs, bits=bits)) == expected(paths(rows))


def test_query_with_odd_rows(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame(rows, TURNS).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    convs = rebuilt(paths(rows))
    assert [] in convs.values()  # some have no turn left
    assert found(T.op11_prefix_trie(spark, str(tmp_path))) == expected(convs)


def test_one_conversation_and_one_node_with_half_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "STRETCH", 16)
    rows = [(5, t, "user", f"turn {t}") for t in range(900)] + [(7, t, "user", f"turn {t}") for t in range(450)]
    rows += [(c, 0, "user", "hello") for c in range(100, 1000)] + [(c, t, "user", f"{c} {t}") for c in range(2000, 2050) for t in range(3)]
    docs = spark.createDataFrame(rows, TURNS).repartition(6)
    assert found(T.prefix_trie(docs)) == expected(paths(rows))


def test_turnless_conversations_end_in_the_root(spark):
    ids = spark.createDataFrame([(4,), (9,), (None,), (4,)], "conv_id long")
    rows = [(6, 0, "user", "hi")]
    got = found(T.prefix_trie(spark.createDataFrame(rows, TURNS), ids))
    assert got == expected({4: [], 9: [], 6: [("user", "hi")]})
    assert found(T.prefix_trie(spark.createDataFrame([], TURNS), ids)) == expected({4: [], 9: []})


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    rel = con.sql(T.ORACLE_SQL)
    assert set(rel.columns) == set(NAMES)
    assert set(rel.project(", ".join(NAMES)).fetchall()) == found(T.op11_prefix_trie(spark, DATA))


def test_empty(spark):
    assert T.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
