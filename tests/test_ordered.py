"""Scans over spread keys held against the window functions of whole keys, and how evenly they spread."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strataline.operators import hotkeys as H
from strataline.operators import intervals as J
from strataline.operators import islands as I
from strataline.operators import memory as Y
from strataline.operators import ordered as O

ROWS = "k string, tp int, s string, o string"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = []
    for k, n in ((None, 30), ("hot", 900), ("a", 1), ("b", 2), ("c", 3), ("long runs", 200), *((f"k{i}", rng.randint(1, 12)) for i in range(40))):
        s, step = "A", 60 if k == "long runs" else 3
        for t in range(n):
            s = rng.choice("ABC") if rng.randint(1, step) == 1 else s
            out.append((k, t * 2, rng.choice(["", "x", "y"]) if k != "long runs" else s, s))
    rng.shuffle(out)
    return spark.createDataFrame(out, ROWS).repartition(5)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    key = lambda df: sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    assert key(a) == key(b)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("frames", [1, 2, 3, 7])
def test_debounce_and_segments(rows, keys, frames):
    order = ["tp", "k"]
    same(H.debounce(rows, keys, order, "o", frames), I.debounce(rows, keys, order, "o", frames))
    same(H.spread_segments(rows, keys, order, "o", frames), I.segments(rows, keys, order, "o", frames))


@pytest.mark.parametrize("keys", [["k"], []])
def test_runs_windows_and_memory(rows, keys):
    order = ["tp", "k"]
    same(H.with_run(rows, keys, order, ["s", "o"]), I.with_run(rows, keys, order, ["s", "o"]))
    same(H.nested_segments(rows, keys, order, "o", "s"), I.nested_segments(rows, keys, order, "o", "s"))
    same(H.count_windows(rows, keys, order, 7), I.count_windows(rows, keys, order, 7))
    known = rows.where("k is not null")
    same(H.with_memory(known, keys, order, "s", "o"), Y.with_memory(known, keys, order, "s", "o") if keys else Y.with_memory(known.withColumn("z", F.lit(1)), ["z"], order, "s", "o").drop("z"))


def test_as_of(rows):
    q, v = rows.select("k", "tp"), rows.where("s = 'x'").select("k", (F.col("tp") + F.when(F.col("o") == "A", 1).otherwise(0)).alias("at"))
    same(H.as_of(q, v, ["k"], "tp", "at"), J.as_of(q, v, ["k"], "tp", "at"))


def test_all_scans(rows):
    w = Window.partitionBy("k").orderBy("tp")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    x = F.when(F.col("s") == "x", F.col("tp"))
    line = O.Line.of(rows, "k", "tp").scan(a=O.previous("s"), b=O.following("o"), c=O.running("tp"), d=O.carried(x), e=O.carried(x, ahead=True))
    want = rows.withColumns({"a": F.lag("s").over(w), "b": F.lead("o").over(w), "c": F.sum("tp").over(back), "d": F.last(x, True).over(back), "e": F.first(x, True).over(ahead)})
    same(line.done(), want)
    some = O.Line.of(rows, "k", "tp").scan(where=F.col("s") == "x", n=O.running(F.lit(1)), t=O.last_items(F.array("tp"), 3)).done().where("s = 'x'")
    near = F.flatten(F.collect_list(F.array("tp")).over(w.rowsBetween(-2, 0)))
    same(some, rows.where("s = 'x'").withColumns({"n": F.count("*").over(back), "t": near}))


def test_ranks(rows):
    got = [r["tp"] for r in O.rank_all(rows, ["tp", "k"]).orderBy("rank").collect()]
    assert got == sorted(got)
    assert [r["rank"] for r in O.rank_all(rows, "tp").orderBy("rank").collect()] == list(range(rows.count()))
    assert O.rank_all(rows.where("false"), "tp").count() == 0


def test_choice_by_the_largest_key(rows):
    assert O.largest_key(rows, "k") == 900 and O.largest_key(rows.where("false"), "k") == 0
    for hot in (10, 10_000):
        same(H.segments(rows, "k", "tp", "o", 2, hot=hot), I.segments(rows, "k", "tp", "o", 2))


def test_empty(rows):
    none = rows.where("false")
    assert H.spread_segments(none, ["k"], ["tp"], "o").count() == 0 and H.with_memory(none, ["k"], ["tp"], "s", "o").count() == 0


def test_one_key_of_a_million_rows_is_spread(spark):
    keep = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        df = spark.range(1_000_000).select(F.lit("one").alias("k"), F.col("id").alias("tp"), (F.xxhash64("id") % 3 == 0).alias("s"))
        line = H._debounced(O.Line.of(df, "k", "tp"), "s", 2)
        sizes = [r["count"] for r in line.rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 1_000_000 and max(sizes) <= 2 * 1_000_000 / 8
        assert "Exchange SinglePartition" not in line.rows._jdf.queryExecution().toString()
        same(H._runs(line, "s", "run").done().groupBy("run").count().groupBy("count").agg(F.count("*").alias("runs")), I.segments(df, "k", "tp", "s", 2).groupBy(F.col("n_frames").alias("count")).agg(F.count("*").alias("runs")))
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)
