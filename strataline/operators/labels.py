"""From a hierarchy's segments to labels per frame, and the clean-up of segments without times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import expand


def frame_labels(l0: DataFrame, l1: DataFrame, l2: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tp, l0_id, l0, l1_id, l1, l2_id, l2) for every time point that a level-0 segment spans, gaps included.

    l0: keys, segment_id, ord, tp_start, tp_end (whole numbers), description; l1, l2: keys, segment_id, ord, children, summary.
    Overlaps go to the later segment, a child listed twice to its last parent, and a segment without parents has no labels.
    """

    def links(parent: DataFrame, child: str, name: str) -> DataFrame:
        return parent.select(*keys, F.posexplode("children").alias("_i", child), F.struct("ord", "_i").alias("_o"), F.col("segment_id").alias(f"{name}_id"), F.col("summary").alias(name)).withColumnRenamed("_o", "o")

    rows = l0.select(*keys, F.col("segment_id").alias("l0_id"), F.col("description").alias("l0"), "ord", "tp_start", "tp_end")
    for parent, child, name in ((l1, "l0_id", "l1"), (l2, "l1_id", "l2")):
        one = links(parent, child, name).groupBy(*keys, child).agg(F.max_by(F.struct(f"{name}_id", name), "o").alias("_p")).select(*keys, child, "_p.*")
        rows = rows.join(one, [*keys, child])
    return expand(rows, "tp_start", "tp_end", "tp", keys, "ord").select(*keys, "tp", "l0_id", "l0", "l1_id", "l1", "l2_id", "l2")


def time_points(l0: DataFrame, l1: DataFrame, l2: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, l2_id, tp): the distinct time points below each level-2 segment; missing children are skipped."""
    steps = l2.select(*keys, F.col("segment_id").alias("l2_id"), F.explode("children").alias("l1_id"))
    parts = l1.select(*keys, F.col("segment_id").alias("l1_id"), F.explode("children").alias("l0_id"))
    spans = l0.select(*keys, F.col("segment_id").alias("l0_id"), F.explode(F.sequence("tp_start", "tp_end")).alias("tp"))
    return steps.join(parts, [*keys, "l1_id"]).join(spans, [*keys, "l0_id"]).select(*keys, "l2_id", "tp").distinct()


def drop_untimed(l0: DataFrame, l1: DataFrame, l2: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without level-0 segments that lack a time; where a key lost some, ids of gone children and emptied parents go as well."""
    timed = F.col("time_start").isNotNull() & F.col("time_end").isNotNull()
    touched = l0.where(~timed).select(*keys).distinct().withColumn("_touched", F.lit(True))
    kept0 = l0.where(timed)

    def cascade(parent: DataFrame, children: DataFrame) -> DataFrame:
        alive = children.groupBy(*keys).agg(F.collect_set("segment_id").alias("_alive"))
        rows = parent.join(touched, keys, "left").join(alive, keys, "left")
        left = F.array_intersect("children", F.coalesce("_alive", F.array().cast("array<string>")))
        rows = rows.withColumn("children", F.when(F.col("_touched"), left).otherwise(F.col("children")))
        return rows.where(F.col("_touched").isNull() | (F.size("children") > 0)).select(*parent.columns)

    kept1 = cascade(l1, kept0)
    return kept0, kept1, cascade(l2, kept1)


def role_rank(role: F.Column, people, robots, tools) -> F.Column:
    """People, then robots, then tools, then all others."""
    return F.when(role.isin(*people), 0).when(role.isin(*robots), 1).when(role.isin(*tools), 2).otherwise(3)

