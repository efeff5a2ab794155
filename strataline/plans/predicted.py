"""Queries over predictions of many groups, with the events as frames, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.wavefront import PredictionRuns, Request
from ..sources.files import scratch
from .samples import _MEMORY
from .timelines import E, events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def echo(requests: list[Request]) -> list[str]:
    """A model that says the last change it was told of, and how many keys the group has shown."""
    out = []
    for _, _, memory in requests:
        told = dict(line.split(": ", 1) for line in memory.splitlines() if ": " in line)
        out.append(f"L0: {told['Short'].split('; ')[-1] if 'Short' in told else ''} | L1: {len(told['Long'].split('; ')) if 'Long' in told else 0}")
    return out


@query(f"WITH {E}, {_MEMORY} SELECT event_id, CASE WHEN len(short) > 0 THEN short[len(short)] ELSE '' END AS pred_l0, CAST(len(long) AS VARCHAR) AS pred_l1 FROM o")
def predictions_resumed(spark, d):
    """Two runs: the first has a third of the groups, the second all of them, and asks for those alone that are left."""
    stamp = F.date_format("ts", "yyyyMMddHHmmssSSSSSS")
    rows = events(spark, d).select(
        F.format_string("%012d", "event_id").alias("id"), F.lit("x").alias("take"), F.concat(F.lit("u"), "user_id").alias("role"), F.lit("").alias("role_human"), F.lit("s").alias("l2_segment_id"),
        stamp.alias("tp_id"), F.array().cast("array<string>").alias("image"), F.col("event_type").alias("gt_l0"), F.concat(F.lit("p"), F.col("k") % 2).alias("gt_l1"), F.lit("").alias("gt_l2"),
    )
    runs = PredictionRuns(spark, scratch(spark, "predictions"))
    runs.run(rows.where(F.crc32("role") % 3 == 0), echo, "gt")
    runs.run(rows, echo, "gt")
    return runs.rows().select(F.col("id").cast("long").alias("event_id"), "pred_l0", "pred_l1")
