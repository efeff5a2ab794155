"""Trivial baselines: the commonest label, the label before, and a random training label."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .assemble import majority
from .ordered import Line, carried

LEVELS = ("l0", "l1", "l2")


def majority_class(train: DataFrame, test: DataFrame, order: str = "ord") -> DataFrame:
    """Every test row with the commonest training label of each level (empty if there is none)."""
    out = test
    for x in LEVELS:
        one = majority(train, [], f"gt_{x}", order).select(F.coalesce(F.max(f"gt_{x}"), F.lit("")).alias(f"pred_{x}"))
        out = out.join(F.broadcast(one))  # one row
    return out


def copy_last(test: DataFrame, order: str = "ord", by_take: bool = False) -> DataFrame:
    """The truth of the frame before in the same role and level-2 segment; takes are mixed unless `by_take`."""
    w = Window.partitionBy(*(["take"] if by_take else []), "role", "l2_segment_id").orderBy("tp_id", order)
    return test.select("*", *(F.lag(f"gt_{x}", 1, "").over(w).alias(f"pred_{x}") for x in LEVELS))


#: Ranges that the labels of a training set are counted in; a label's range follows from a hash.
RANGES = 256
#: Distinct labels of a level up to which a table of them is sent to the workers.
TABLE_LABELS = 100_000


def _hash(*parts: Column) -> Column:
    """A whole number below 2**32 from the text of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def _laid_end_to_end(train: DataFrame, column: str) -> DataFrame:
    """(place, label, n): the distinct labels with where each starts, in order of range and label. Null counts as empty."""
    counts = train.groupBy(F.coalesce(F.col(column), F.lit("")).alias("label")).agg(F.count("*").alias("n")).withColumn("part", _hash(F.col("label")) % RANGES)
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("n").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(upto), F.lit(0)))  # at most RANGES rows
    inside = Window.partitionBy("part").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("place", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(parts.select("part", "first")), "part")
    return placed.select((F.col("first") + F.col("place")).alias("place"), "label", "n")


def random_label(train: DataFrame, test: DataFrame, seed: int = 42, table: int = TABLE_LABELS) -> DataFrame:
    """Labels drawn independently per level by a hash of the test id, each as often as it stands in the training rows.

    The distinct labels are laid end to end, each as long as its count, and a test row takes the label at its place: its hash
    modulo the number of training rows. Up to `table` labels are looked up by binary search in a copy that each worker has, so
    rows stay where they are; with more, ids alone are put in one order with the labels' starts and spread over all tasks, so
    that a label of any share is no task's alone. Null labels count as empty; without training rows all are.
    """
    out = test
    for k, x in enumerate(LEVELS):
        starts = _laid_end_to_end(train, f"gt_{x}")
        known = sorted(map(tuple, starts.limit(table + 1).collect()))  # at most table + 1 labels
        if len(known) <= table:
            out = out.withColumn(f"pred_{x}", _looked_up(known)(_hash(F.lit(seed), F.lit(k), F.col("id"))))
        else:
            out = _spread_lookup(out, starts, _hash(F.lit(seed), F.lit(k), F.col("id")), f"pred_{x}")
    return out


def _looked_up(known: list[tuple]):
    """A column's label at the place that its hash gives."""
    places, labels = np.array([p for p, _, _ in known], np.int64), np.array([label for _, label, _ in known] or [""], object)
    total = sum(n for _, _, n in known)

    @F.pandas_udf("string")
    def run(hashes: pd.Series) -> pd.Series:
        return pd.Series(labels[np.maximum(np.searchsorted(places, hashes.to_numpy() % max(total, 1), side="right") - 1, 0)])

    return run


def _spread_lookup(rows: DataFrame, starts: DataFrame, hashed: Column, out: str) -> DataFrame:
    total = starts.agg(F.sum("n")).first()[0]
    drawn = rows.select("id", (hashed % total).alias("place")).distinct().select("place", F.lit(1).alias("_q"), F.lit(None).cast("string").alias("label"), F.col("id").alias("_id"))
    both = drawn.unionByName(starts.select("place", F.lit(0).alias("_q"), "label"), allowMissingColumns=True)
    found = Line.of(both, [], ["place", "_q", "_id"]).scan(**{out: carried(F.col("label"))}).done().where("_q = 1").select("_id", out)
    return rows.join(found, rows["id"].eqNullSafe(found["_id"]), "left").drop("_id")


def baseline_predictions(train: DataFrame, test: DataFrame, seed: int = 42, order: str = "ord") -> dict[str, DataFrame]:
    """The three baselines as prediction rows: id, role, tp_id, l2_segment_id, pred_<level>, gt_<level>.

    train, test: id, role, tp_id, gt_l0 .. gt_l2, gt_l2_seg_id, `order`.
    """
    rows = test.withColumn("l2_segment_id", F.col("gt_l2_seg_id"))
    made = {"majority_class": majority_class(train, rows, order), "copy_last": copy_last(rows, order), "random": random_label(train, rows, seed)}
    return {name: t.select("id", "role", "tp_id", "l2_segment_id", *(f"pred_{x}" for x in LEVELS), *(f"gt_{x}" for x in LEVELS)) for name, t in made.items()}
