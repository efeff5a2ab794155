"""Window closed forms held against sequential restatements."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.operators import islands as I
from strataline.operators import memory as Y
from strataline.streaming.segments import OnlineDebounce


def sequential(states, frames):
    runs = []
    for i, s in enumerate(states):
        if runs and runs[-1][0] == s:
            runs[-1][1].append(i)
        else:
            runs.append([s, [i]])
    out, last = [], None
    for k, (s, rows) in enumerate(runs):
        if k == 0 or len(rows) >= frames or len(states) < 3 or frames <= 1:
            last = s
        if out and out[-1][0] == last:
            out[-1][1].extend(rows)
        else:
            out.append([last, list(rows)])
    return [(s, rows[0], rows[-1], len(rows)) for s, rows in out]


@pytest.fixture(scope="module")
def timelines():
    rng = random.Random(1)
    return {k: [rng.choice("AB" if k % 2 else "ABCD") for _ in range(rng.randint(1, 40))] for k in range(60)} | {100: list("ABBB"), 101: list("AABACDEE"), 102: list("AB"), 103: ["A"]}


@pytest.mark.parametrize("frames", [1, 2, 3, 5])
def test_segments(spark, timelines, frames):
    rows = [(k, i * 3, s) for k, states in timelines.items() for i, s in enumerate(states)]  # gaps do not end runs
    random.Random(2).shuffle(rows)
    got = I.segments(spark.createDataFrame(rows, "k int, tp int, s string"), "k", "tp", "s", frames).orderBy("k", "segment").collect()
    for k, states in timelines.items():
        mine = [(r.s, r.tp_start // 3, r.tp_end // 3, r.n_frames) for r in got if r.k == k]
        assert mine == sequential(states, frames), (k, states)


@pytest.mark.parametrize("frames", [1, 2, 3])
def test_online_equals_batch(timelines, frames):
    for states in timelines.values():
        online, out = OnlineDebounce(frames), []
        for i, s in enumerate(states):
            out += online.push(i, s)
            online = OnlineDebounce(frames, online.saved())
        out += online.close()
        assert [tuple(x) for x in out] == sequential(states, frames)


def test_known_cases():
    assert [s for s, *_ in sequential(list("AABACDEE"), 2)] == ["A", "E"]
    assert sequential(list("ABBB"), 2)[0] == ("A", 0, 0, 1)


def test_null_states_are_runs_of_their_own(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([None, None, "A", None])], "k int, tp int, s string")
    assert [r.run for r in I.with_run(df, "k", "tp", "s").orderBy("tp").collect()] == [1, 1, 2, 3]


def test_nested(spark):
    rows = [(1, i, a, b) for i, (a, b) in enumerate(["xp", "xp", "yp", "yq", "xq"])]
    got = I.nested_segments(spark.createDataFrame(rows, "k int, tp int, outer string, inner string"), "k", "tp", "outer", "inner").orderBy("tp").collect()
    assert [(r.outer_run, r.inner_run) for r in got] == [(1, 1), (1, 1), (2, 2), (2, 3), (3, 4)]


@pytest.mark.parametrize(("n", "expected"), [(1, [(0, 0)]), (30, [(0, 29)]), (31, [(0, 29), (27, 30)]), (57, [(0, 29), (27, 56)]), (58, [(0, 29), (27, 56), (54, 57)])])
def test_chunks(spark, n, expected):
    df = spark.range(n).withColumn("k", F.lit(1))
    got = I.overlapping_chunks(df, "k", "id").groupBy("chunk").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).orderBy("chunk").collect()
    assert [(r.a, r.b) for r in got] == expected


def test_adjacent_groups(spark):
    angles = np.cumsum([0, 0.3, 0.6, 0.61, 0.1])
    rows = [(1, i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)] + [(2, 0, [0.0, 0.0]), (2, 1, [1.0, 0.0])]
    limit = float(1 - np.cos(0.605))
    got = I.adjacent_groups(spark.createDataFrame(rows, "k int, tp int, v array<double>"), "k", "tp", "v", limit).orderBy("k", "tp").collect()
    assert [r.group for r in got] == [0, 0, 0, 1, 1, 0, 0] and got[-1].distance is None


def test_noise_categories(spark):
    states = {0: "a", 1: "b", 2: "a", 3: "a", 10: "c", 20: "a", 21: "", 22: "b", 23: "b", 31: "a", 32: "b", 33: "b", 40: "a", 41: "a", 42: "b"}
    rows = [("r", t, [s] if s else []) for t, s in states.items()]
    got = {r.ts: r.category for r in I.one_row_noise(spark.createDataFrame(rows, "k string, ts int, state array<string>"), "k", "ts", "state").collect()}
    assert got[1] == "FLICKER" and got[10] == "FLICKER" and got[21] == "DROPOUT" and got[31] == "PRE_TRANSITION" and got[42] == "POST_ACTIVITY"


def test_memory_equals_builder(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice(["", "a", "b"]), rng.choice(["", "x", "y"])) for k in range(20) for i in range(25)]
    df = spark.createDataFrame(rows, "k int, tp int, l0 string, l1 string")
    got = {(r.k, r.tp): (r.long_term, r.short_term) for r in Y.with_memory(df, ["k"], ["tp"]).collect()}
    for k in range(20):
        b = Y.MemoryBuilder()
        for _, i, l0, l1 in [r for r in rows if r[0] == k]:
            assert got[k, i] == b.before()
            b.record(l0, l1)


def test_one_shuffle_serves_the_chain(spark):
    df = spark.range(100).selectExpr("id % 3 as k", "id as tp", "cast(id % 2 as string) as s")
    plan = I.debounce(df, "k", "tp", "s")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
