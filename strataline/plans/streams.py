"""Queries that stream the events, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.files import scratch
from ..streaming.memory import MemoryStream
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


@query(f"WITH {E}, {_MEMORY} SELECT event_id, array_to_string(long, '; ') AS long_term, array_to_string(short, '; ') AS short_term FROM o")
def memory_of_a_stream(spark, d):
    """Events come up to twelve hours late, in three parts; a run of the stream takes each from the checkpoint of the last."""
    part = F.concat(F.lit("p"), F.col("k") % 2)
    frames = events(spark, d).select(F.concat(F.lit("u"), "user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.col("event_type").alias("l0"), part.alias("l1"), (F.col("hour") + F.col("event_id") % 12).alias("comes"))
    end = spark.range(1).select(F.lit("end").alias("key"), F.lit("2100-01-01").cast("timestamp").alias("ts"), F.col("id"), F.lit("").alias("l0"), F.lit("").alias("l1"))
    source = scratch(spark, "frames")
    stream = MemoryStream(spark, source, delay="13 hours")
    comes = F.col("comes")
    for arrived in (frames.where(comes < 240).drop("comes"), frames.where((comes >= 240) & (comes < 480)).drop("comes"), frames.where(comes >= 480).drop("comes"), end):
        arrived.write.mode("append").parquet(source)
        if arrived is not end:
            stream.run()
    stream.run()
    rows = stream.rows().where("key <> 'end'")
    return rows.select(F.col("id").alias("event_id"), F.array_join("long_term", "; ").alias("long_term"), F.array_join("short_term", "; ").alias("short_term"))
