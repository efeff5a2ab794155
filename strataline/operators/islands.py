"""Runs of equal state, debounce, windows by count, and adjacent-only clustering: all closed forms over window functions.

Every step partitions by the same keys, so one shuffle serves a whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _names(columns) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def with_run(df: DataFrame, keys, order, states, run: str = "run") -> DataFrame:
    """Number the maximal runs of equal `states` (one or more columns) by row adjacency, from 1."""
    w = Window.partitionBy(*_names(keys)).orderBy(*_names(order))
    same = F.lag(F.lit(True)).over(w).isNotNull()
    for s in _names(states):
        same = same & F.lag(s).over(w).eqNullSafe(F.col(s))
    return df.withColumn(run, F.sum(F.when(same, 0).otherwise(1)).over(w))


def debounce(df: DataFrame, keys, order, state: str, frames: int = 2) -> DataFrame:
    """Replace `state` in runs shorter than `frames` by that of the last run kept; the first run always stays.

    No change where a group has under three rows or frames <= 1. States must not be null (an empty array is a state).
    """
    if frames <= 1:
        return df
    k = _names(keys)
    w = Window.partitionBy(*k).orderBy(*_names(order))
    every = Window.partitionBy(*k)
    marked = with_run(df, k, order, state, "_run").withColumn("_len", F.count("*").over(Window.partitionBy(*k, "_run"))).withColumn("_n", F.count("*").over(every))
    keep = (F.col("_run") == 1) | (F.col("_len") >= frames) | (F.col("_n") < 3)
    return marked.withColumn(state, F.last(F.when(keep, F.col(state)), ignorenulls=True).over(w)).drop("_run", "_len", "_n")


def segments(df: DataFrame, keys, order, state: str, frames: int = 2, tp: str | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Level-0 segments: keys, segment number (from 0), tp_start, tp_end, n_frames (rows) and the state.

    Gaps between time points do not end a run. extra: more aggregates by name.
    """
    k, o = _names(keys), _names(order)
    return collapsed(with_run(debounce(df, k, o, state, frames), k, o, state), k, o, state, tp or o[0], extra)


def collapsed(runs: DataFrame, keys: list, order: list, state: str, tp: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """A row per run (column `run`, from 1) of each key, as `segments` gives them."""
    at = F.struct(*order)
    found = runs.groupBy(*keys, "run").agg(
        F.min_by(tp, at).alias("tp_start"), F.max_by(tp, at).alias("tp_end"), F.count("*").alias("n_frames"), F.first(state).alias(state), *(c.alias(n) for n, c in (extra or {}).items())
    )
    return found.withColumn("segment", F.col("run") - 1).drop("run")


def nested_segments(df: DataFrame, keys, order, outer: str, inner: str) -> DataFrame:
    """Rows with the run of `outer` and the run of `inner`, which a change of outer also ends; both from 1 within keys."""
    return with_run(with_run(df, keys, order, outer, "outer_run"), keys, order, [outer, inner], "inner_run")


def count_windows(df: DataFrame, keys, order, size: int) -> DataFrame:
    """Tumbling windows of `size` rows, from 0; the last may be short."""
    w = Window.partitionBy(*_names(keys)).orderBy(*_names(order))
    return df.withColumn("window", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def overlapping_chunks(df: DataFrame, keys, order, size: int = 30, overlap: int = 3) -> DataFrame:
    """A row for each chunk a row belongs to: starts are 0, size - overlap, ...; the chunk that reaches the end is the last."""
    k = _names(keys)
    w, step = Window.partitionBy(*k).orderBy(*_names(order)), size - overlap
    numbered = df.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).withColumn("_n", F.count("*").over(Window.partitionBy(*k)))
    final = F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / step))
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - size + 1) / step))
    last = F.least(final, F.floor(F.col("pos") / step))
    return numbered.withColumn("chunk", F.explode(F.sequence(first.cast("long"), last.cast("long")))).drop("_n")


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two vectors, in double precision; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def adjacent_groups(df: DataFrame, keys, order, vector: str, threshold: float) -> DataFrame:
    """Distance to the row before, and a group number that rises where it exceeds `threshold`.

    Merging the closest neighbours first, with distances that never change, ends in just these cuts.
    """
    w = Window.partitionBy(*_names(keys)).orderBy(*_names(order))
    out = df.withColumn("distance", cosine_distance(F.lag(vector).over(w), F.col(vector)))
    return out.withColumn("group", F.sum(F.when(F.col("distance") > threshold, 1).otherwise(0)).over(w))


def noise_category(before: Column, current: Column, after: Column) -> Column:
    """What a one-row run is, from the states one second before and after (arrays, empty where there is none)."""
    return (
        F.when(before.eqNullSafe(after), "FLICKER")
        .when(F.size(current) == 0, "DROPOUT")
        .when((F.size(before) == 0) & (F.size(after) > 0), "PRE_TRANSITION")
        .when(F.size(after) == 0, "POST_ACTIVITY")
        .otherwise("UNIQUE")
    )


def one_row_noise(timeline: DataFrame, keys, ts: str, state: str, tp: str | None = None) -> DataFrame:
    """The one-row runs of a timeline with their category; neighbours are looked up by time, not by row."""
    order, k = [tp or ts], _names(keys)
    runs = with_run(timeline, k, order, state).withColumn("_len", F.count("*").over(Window.partitionBy(*k, "run")))
    single = runs.where((F.col("_len") == 1) & F.col(ts).isNotNull()).select(*k, ts, *(c for c in order if c != ts))
    by_time = timeline.where(F.col(ts).isNotNull()).groupBy(*k, ts).agg(F.max_by(state, F.col(order[0])).alias("_s"))
    none = F.array().cast(timeline.schema[state].dataType)
    at = lambda shift, name: by_time.select(*k, (F.col(ts) - shift).alias(ts), F.col("_s").alias(name))
    joined = single.join(at(0, "current"), [*k, ts], "left").join(at(-1, "before"), [*k, ts], "left").join(at(1, "after"), [*k, ts], "left")
    for name in ("before", "current", "after"):
        joined = joined.withColumn(name, F.coalesce(name, none))
    return joined.withColumn("category", noise_category(F.col("before"), F.col("current"), F.col("after")))
