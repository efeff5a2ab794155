import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from strataline.llm import common as C
from strataline.llm import substring as S

from .helpers import DATA, DOCS, clashing, empty, odd_documents, words


def brute(rows, size=13):
    """(id, n_words, n_removed, hash of kept words); a null id is larger than all."""
    last = 1 << 62
    low = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            low[x] = min(low.get(x, last), last if i is None else i)
    out = []
    for i, text in rows:
        w, gone = words(text), set()
        for k in range(len(w) - size + 1):
            if low[tuple(w[k : k + size])] < (last if i is None else i):
                gone.update(range(k, k + size))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def random_rows():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(6)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    rows = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 50))]
        if i % 3 == 0:
            a = rng.randint(0, 40)
            w = w + passage[a : a + rng.randint(10, 30)] + w[:5]
        rows.append((i, " ".join(w), "en", "s", 1))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"batches": 6, "max_runs": 1}, {"batches": 3, "bits": 6}, {"window": 3, "batches": 5}, {"batches": 1}])
def test_matches_brute_force(spark, options):
    """Few runs force compaction; few key bits force every match through the second hash."""
    docs = odd_documents(spark, random_rows())
    got = S.dedup(clashing(docs), **options).collect()
    assert Counter(map(tuple, got)) == Counter(brute([(r.doc_id, r.text) for r in docs.collect()], options.get("window", 13)))


def test_history_is_judged_across_calls(spark):
    """Batches that come one after another, over an index that stays."""
    root = C.scratch(spark, "test-index")
    a, b = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    first = spark.createDataFrame([(5, a, "", "", 1)], DOCS)
    second = spark.createDataFrame([(1, "new " + a[8:], "", "", 1), (2, b, "", "", 1)], DOCS)
    third = spark.createDataFrame([(0, b, "", "", 1)], DOCS)
    assert S.dedup(first, batches=1, root=root).first().n_removed == 0
    # ids in the order of the calls: what stands in the index comes first
    expected = [n for _, _, n, _ in brute([(0, a), (1, "new " + a[8:]), (2, b), (3, b)])]
    assert {r.doc_id: r.n_removed for r in S.dedup(second, batches=1, root=root).collect()} == {1: expected[1], 2: expected[2]}
    assert S.dedup(third, batches=1, root=root).first().n_removed == expected[3]
    C.remove(spark, root)


def test_stage_cuts_passages_and_keeps_the_rest(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"Head one.\n{passage}\nTail one.", "en", "s", 0), (2, f"  Head\ttwo.\n{passage}\nEnd of two.  ", "en", "s", 0), (3, passage, "en", "s", 0), (4, None, "en", "s", None), (5, "", "en", "s", 0)]
    docs = clashing(spark.createDataFrame(rows, DOCS))
    got = {r.doc_id: r for r in S.stage(spark, docs, "").collect()}
    assert set(got) == {1, 2, 4, 5} and got[1].text == rows[0][1] and got[4].text is None and got[5].text == ""
    removed = {i: (n, m) for i, n, m, _ in brute([r[:2] for r in rows])}
    assert removed[2] == (65, 60) and removed[3] == (60, 60)
    assert got[2].text == "  Head\ttwo.\nEnd of two.  " and got[2].id == "clash" and got[2].n_chars == len(got[2].text)
    assert S.stage(spark, docs, "").columns == docs.columns


def thue_morse(n, a="ab"):
    return "".join(a[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("length", [16, 32, 1024, 4096])
def test_words_that_collide_in_polynomials(spark, length):
    """Words that agree in every polynomial hash with an odd base modulo 2**64, alone and as patterns of words."""
    a, b = thue_morse(length), thue_morse(length, "ba")
    same = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([*same, a])), (2, " ".join([*same, b])), (3, " ".join(thue_morse(64, "xy"))), (4, " ".join(thue_morse(64, "yx"))), (5, " ".join([*same, a]))]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS)
    for options in ({}, {"batches": 1}, {"window": 2}):
        assert Counter(map(tuple, S.dedup(docs, **options).collect())) == Counter(brute(rows, options.get("window", 13)))


def test_a_batch_counts_when_its_rows_stand(spark):
    """A call that fails may be repeated; a named batch is taken once."""
    root = C.scratch(spark, "test-index")
    text = " ".join(f"x{i}" for i in range(40))
    docs = spark.createDataFrame([(5, text, "", "", 1)], DOCS)
    index = S.FingerprintIndex(spark, root, 64)
    asked = docs.selectExpr("doc_id id", "xxhash64(text) key", "text")
    flags, _ = index.judge(asked, "monday")  # the caller fails before its rows are written
    assert flags.count() == 0
    assert S.dedup(docs, batches=1, root=root, name="monday").first().n_removed == 0
    with pytest.raises(ValueError, match="monday"):
        S.dedup(docs, batches=1, root=root, name="monday")
    assert S.dedup(docs, batches=1, root=root, name="tuesday").first().n_removed == 40
    C.remove(spark, root)


@pytest.mark.parametrize("name", [None, "load"])
@pytest.mark.parametrize("failing", [1, 2, 3, 4])
def test_a_call_of_several_batches_that_fails_may_be_repeated(spark, monkeypatch, name, failing):
    """Every batch in turn fails while its rows are written; the repeated call gives the rows of a call that did not fail."""
    root = C.scratch(spark, "test-index")
    old = [(1000 + i, " ".join(f"o{i}w{k}" for k in range(20))) for i in range(4)]
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(25))) for i in range(16)] + [(20, old[1][1]), (21, old[3][1] + " tail"), (22, " ".join(f"d3w{k}" for k in range(25)))]
    frame = lambda x: spark.createDataFrame([(*r, "", "", 1) for r in x], DOCS)
    S.dedup(frame(old), batches=2, root=root)
    before = S.FingerprintIndex(spark, root, 64).state
    calls, clean = [], S._clean

    def fails(*args):
        calls.append(1)
        if len(calls) == failing:
            raise RuntimeError("lost")
        return clean(*args)

    monkeypatch.setattr(S, "_clean", fails)
    with pytest.raises(RuntimeError, match="lost"):
        S.dedup(frame(rows), batches=4, root=root, name=name)
    monkeypatch.setattr(S, "_clean", clean)
    assert S.FingerprintIndex(spark, root, 64).state == before
    want = {i: n for i, _, n, _ in brute([(i - 2000, t) for i, t in old] + rows)}
    got = S.dedup(frame(rows), batches=4, root=root, name=name).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: want[i] for i, _ in rows}
    state = S.FingerprintIndex(spark, root, 64).state
    assert sorted(n for n in C.listed(spark, root) if n.startswith("run-")) == sorted(n for n, _ in state["runs"])  # nothing is left behind
    again = S.dedup(frame(rows), batches=1, root=root).collect()
    assert all(r.n_removed == r.n_words for r in again)
    C.remove(spark, root)


def test_runs_merge_by_tier(spark):
    root = C.scratch(spark, "test-index")
    index = S.FingerprintIndex(spark, root, 2)
    for k in range(7):
        docs = spark.createDataFrame([(k, k, " ".join(f"x{k}y{i}" for i in range(20)))], "id long, key long, text string")
        index.judge(docs)[1]()
    assert [t for _, t in index.state["runs"]] == [2, 1, 0] and S.FingerprintIndex(spark, root, 9).state == index.state
    docs = spark.createDataFrame([(k, k, " ".join(f"x{k}y{i}" for i in range(20))) for k in range(7)], "id long, key long, text string")
    flags, done = index.judge(docs, keep=False)
    assert {r.id for r in flags.collect() if r.data} == set(range(7))
    done()
    C.remove(spark, root)


def test_query_on_the_driver_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = S.op2_substring_dedup(spark, DATA).collect()
    assert Counter(map(tuple, got)) == Counter(brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_empty(spark):
    assert S.dedup(empty(spark)).count() == 0
    assert S.stage(spark, empty(spark), "").count() == 0


def test_runs_round_trip():
    rng = np.random.default_rng(2)
    h1 = np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    h1[10:13] = h1[10]
    h2 = rng.integers(0, 1 << 32, 500).astype(np.uint32)
    run = S.open_run(S.pack_run(h1, h2))
    assert (run[0] == h1).all() and (run[1] == h2).all()
    assert S.in_run(run, h1, h2).all() and not S.in_run(run, h1, h2 + np.uint32(1)).any()
    assert not S.in_run(S.open_run(S.pack_run(h1[:0], h2[:0])), h1, h2).any()
