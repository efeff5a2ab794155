"""Predicted frames put together again: nested runs, majority votes, and the rows of a hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import l2_index
from .islands import nested_segments


def majority(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value): the commonest value; of equally common ones the first seen by `order`.

    Counts are small rows per key and value, so a key that holds most of the input is still summed before it is shuffled.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("_n")).alias("_n"), "_first")).alias(value))


def _or_zero(time: Column) -> Column:
    return F.coalesce(time, F.lit(0))


def assemble(frames: DataFrame, by_take: bool = False) -> dict[str, DataFrame]:
    """Tables l0, l1, l2 of predicted frames (take, role, l2_segment_id, tp_id, l0, l1, l2, time).

    Level 0 is numbered anew in every level-2 segment, and takes are one unless `by_take`: both as users expect of the format.
    """
    keys = [*(["take"] if by_take else []), "role", "l2_segment_id"]
    order = ["tp_id", *([] if by_take else ["take"])]
    position = F.row_number().over(Window.partitionBy(*[k for k in keys if k != "l2_segment_id"]).orderBy("l2_segment_id")) - 1
    numbers = frames.select(*keys).distinct().withColumn("l2_index", l2_index(F.col("l2_segment_id"), position))
    runs = nested_segments(frames, keys, order, "l1", "l0").join(numbers, keys)
    at = F.struct(*order)
    ends = lambda: (F.min_by("tp_id", at).alias("tp_start"), F.max_by("tp_id", at).alias("tp_end"), _or_zero(F.min_by("time", at)).alias("time_start"), _or_zero(F.max_by("time", at)).alias("time_end"), F.count("*").alias("n_frames"))
    l1_id = F.format_string("%s_L1_%03d_%03d", F.col("role").cast("string"), F.col("l2_index"), F.col("outer_run") - 1)
    l0 = runs.groupBy(*keys, "l2_index", "outer_run", "inner_run").agg(*ends(), F.first("l0").alias("description"))
    l0 = l0.withColumn("segment_id", F.format_string("%s_L0_%03d", F.col("role").cast("string"), F.col("inner_run") - 1)).withColumn("parent_id", l1_id)
    l1 = runs.groupBy(*keys, "l2_index", "outer_run").agg(*ends(), F.first("l1").alias("summary")).withColumn("segment_id", l1_id)
    vote = majority(runs.withColumn("_at", at), keys, "l2", "_at")
    l2 = runs.groupBy(*keys, "l2_index").agg(*ends()).join(vote, keys).withColumnRenamed("l2", "summary").withColumn("segment_id", F.format_string("%s_L2_%03d", F.col("role").cast("string"), F.col("l2_index")))
    return {"l0": l0, "l1": l1, "l2": l2}
