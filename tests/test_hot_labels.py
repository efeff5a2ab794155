"""Random labels where one label holds most rows, valid times of tools, and samples of long phases."""

import pytest
from pyspark.sql import functions as F

from strataline.operators import baselines as L
from strataline.plans import training
from strataline.plans import viewer as W

ROWS = "id string, gt_l0 string, gt_l1 string, gt_l2 string"


@pytest.fixture
def sets(spark):
    train = spark.range(500).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 5 > 0, "hot").otherwise(F.concat(F.lit("c"), "id")).alias("gt_l0"), F.when(F.col("id") % 3 > 0, "x").alias("gt_l1"), F.lit("z").alias("gt_l2"))
    return train, spark.range(2000).select(F.concat(F.lit("t"), "id").alias("id"), F.lit(7).alias("more"))


def test_both_lookups_give_the_same_labels(spark, sets):
    train, test = sets
    key = lambda df: sorted(map(repr, (tuple(r[c] for c in ("id", "more", "pred_l0", "pred_l1", "pred_l2")) for r in df.collect())))
    one = L.random_label(train, test)
    assert key(one) == key(L.random_label(train, test, table=1))
    share = one.agg(F.avg((F.col("pred_l0") == "hot").cast("int")), F.avg((F.col("pred_l1") == "").cast("int")), F.min("pred_l2")).first()
    assert abs(share[0] - 0.8) < 0.03 and abs(share[1] - 1 / 3) < 0.04 and share[2] == "z"
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()  # rows stay where they are
    none = L.random_label(train.where("false"), test)
    assert none.where("pred_l0 <> '' or pred_l2 <> ''").count() == 0


def test_a_hot_label_is_no_tasks_alone(spark, sets, monkeypatch):
    train, test = sets
    seen = []
    scan = L.Line.scan

    def watched(self, *args, **kwargs):
        seen.append([r["count"] for r in self.rows.groupBy(F.spark_partition_id()).count().collect()])
        return scan(self, *args, **kwargs)

    monkeypatch.setattr(L.Line, "scan", watched)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        L.random_label(train, test, table=1).count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert seen and all(max(s) <= 2 * sum(s) / 4 for s in seen)


def test_valid_times(spark):
    triplet = "array<struct<subj:string,pred:string,obj:string>>"
    graphs = spark.createDataFrame([("t", 1, [("nurse", "Holding", "saw"), ("nurse", "CloseTo", "patient")]), ("t", 2, [("saw", "Touching", "patient")]), ("t", 3, [])], f"take string, ts int, triplets {triplet}")
    roles = spark.createDataFrame([("t", "nurse", False, False), ("t", "patient", False, False), ("t", "saw", False, True), ("t", "hammer", False, True), ("t", "robot_monitor", True, False), ("u", "nurse", False, False)], "take string, role string, is_robot boolean, is_tool boolean")
    got = {}
    for r in W.valid_times(graphs, roles).collect():
        got.setdefault(r.role, []).append(r.ts)
    assert {k: sorted(v) for k, v in got.items()} == {None: [1, 2, 3], "nurse": [1], "saw": [1, 2], "hammer": [1, 2, 3], "robot_monitor": [1, 2, 3]}
    assert sorted((r.role or "*", r.ts) for r in W.valid_times(graphs).collect()) == [("*", 1), ("*", 2), ("*", 3), ("nurse", 1), ("saw", 2)]


def test_samples_of_a_phase(spark):
    l0 = [("t", "nurse", i, f"s{i}", f"{2 * i:06d}", f"{2 * i + 1:06d}", f"does {i % 3}", None) for i in range(6)]
    up = lambda n, of: [("t", "nurse", i, f"{of}{i}", [f"{'s' if of == 'a' else 'a'}{j}" for j in range(n * i, n * i + n)], f"{of} {i}") for i in range(6 // n if of == "a" else 1)]
    tables = {
        "l0": spark.createDataFrame(l0, "take string, role string, ord int, segment_id string, tp_start string, tp_end string, description string, role_human string"),
        "l1": spark.createDataFrame(up(2, "a"), "take string, role string, ord int, segment_id string, children array<string>, summary string"),
        "l2": spark.createDataFrame(up(3, "b"), "take string, role string, ord int, segment_id string, children array<string>, summary string"),
    }
    dry = training.build_samples(tables, splits={"t": "val"})
    rows = {r.tp_id: r for r in dry.collect()}
    assert sorted(rows) == [f"{i:06d}" for i in range(12)] and rows["000003"].image[0] == "colorimage/camera01_colorimage-000003.jpg" and rows["000003"].split == "val"
    assert "<memory_start>" not in rows["000000"].conversations[0]["value"] and "+L0:does 0" in rows["000002"].conversations[0]["value"] and "-L0:does 0" in rows["000003"].conversations[0]["value"]
    assert rows["000005"].gt_l1_seg_id == "a1" and rows["000005"].conversations[1]["value"] == "L0: does 2 | L1: a 1 | L2: b 0" and rows["000005"].role_human == "nurse"
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(training.build_samples(tables, splits={"t": "val"}, spread=True)) == key(dry)
    frames = spark.createDataFrame([("t", f"{i:06d}", str(100 + i) if i != 4 else None) for i in range(8)], "take string, tp_id string, azure string")
    images = spark.createDataFrame([("t", f"colorimage/camera0{c}_colorimage-{100 + i:06d}.jpg") for i in range(8) for c in range(1, 5) if (i, c) != (6, 3)], "take string, path string")
    assert sorted(r.tp_id for r in training.build_samples(tables, frames, images).collect()) == [f"{i:06d}" for i in (0, 1, 2, 3, 5, 7)]
    assert len({r.conversations[0]["value"] for r in training.build_samples(tables, seed=3).collect()} - {r.conversations[0]["value"] for r in dry.collect()}) > 0
