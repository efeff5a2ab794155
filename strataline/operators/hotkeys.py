"""Runs, debounce, memory and as-of lookups for keys that may hold any share of the rows.

The results are those of the namesakes in `islands`, `memory`, `baselines` and `intervals`, which sort a whole key in one task:
one shuffle, and the choice for many keys of like size. Here every key is spread over all tasks (`ordered.Line`), for two passes
more. `islands.segments` and the others stay as they are; `segments` below takes either by the size of the largest key.
Rows must differ in keys and order, as for any window over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import islands
from .memory import SHORT_TERM, change_events
from .ordered import HOT_ROWS, Line, carried, following, largest_key, last_items, previous, running


def _runs(line: Line, states, run: str) -> Line:
    states = [states] if isinstance(states, str) else list(states)
    both = line.scan(_prior=previous(F.struct(*states)))
    new = F.when(F.col("_prior").isNotNull() & F.col("_prior").eqNullSafe(F.struct(*states)), 0).otherwise(1)
    return _drop(both.with_columns({"_new": new}).scan(**{run: running("_new")}), "_prior", "_new")


def _drop(line: Line, *columns: str) -> Line:
    return Line(line.rows.drop(*columns), line.keys)


def with_run(df: DataFrame, keys, order, states, run: str = "run") -> DataFrame:
    """As `islands.with_run`."""
    return _runs(Line.of(df, keys, order), states, run).done()


def _debounced(line: Line, state: str, frames: int) -> Line:
    if frames <= 1:
        return line
    own = F.struct(state)
    line = line.scan(_prior=previous(own), _next=following(own), _i=running(F.lit(1)))
    starts, ends = ~F.coalesce(F.col("_prior").eqNullSafe(own), F.lit(False)), ~F.coalesce(F.col("_next").eqNullSafe(own), F.lit(False))
    starts, ends = starts | F.col("_prior").isNull(), ends | F.col("_next").isNull()
    line = line.scan(_from=carried(F.when(starts, F.col("_i"))), _to=carried(F.when(ends, F.col("_i")), ahead=True), _n=carried(F.when(F.col("_next").isNull(), F.col("_i")), ahead=True))
    keep = (F.col("_from") == 1) | (F.col("_to") - F.col("_from") + 1 >= frames) | (F.col("_n") < 3)
    line = line.scan(_kept=carried(F.when(keep, F.col(state))))
    return _drop(line.with_columns({state: F.col("_kept")}), "_prior", "_next", "_i", "_from", "_to", "_n", "_kept")


def debounce(df: DataFrame, keys, order, state: str, frames: int = 2) -> DataFrame:
    """As `islands.debounce`: a run's length is the distance between its ends, carried to its rows from both sides."""
    return _debounced(Line.of(df, keys, order), state, frames).done()


def spread_segments(df: DataFrame, keys, order, state: str, frames: int = 2, tp: str | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """As `islands.segments`. Runs are summed up before they are shuffled, so a run of any length is a row per task."""
    keys, order = [keys] if isinstance(keys, str) else list(keys), [order] if isinstance(order, str) else list(order)
    rows = _runs(_debounced(Line.of(df, keys, order), state, frames), state, "run").done()
    return islands.collapsed(rows, keys, order, state, tp or order[0], extra)


def segments(df: DataFrame, keys, order, state: str, frames: int = 2, tp: str | None = None, extra: dict[str, Column] | None = None, hot: int = HOT_ROWS) -> DataFrame:
    """Segments by one window per key, or spread where a key has more than `hot` rows. Counts the keys first."""
    way = spread_segments if largest_key(df, keys) > hot else islands.segments
    return way(df, keys, order, state, frames, tp, extra)


def nested_segments(df: DataFrame, keys, order, outer: str, inner: str) -> DataFrame:
    """As `islands.nested_segments`."""
    return _runs(_runs(Line.of(df, keys, order), outer, "outer_run"), [outer, inner], "inner_run").done()


def count_windows(df: DataFrame, keys, order, size: int) -> DataFrame:
    """As `islands.count_windows`."""
    line = Line.of(df, keys, order).scan(_i=running(F.lit(1)))
    return _drop(line.with_columns({"window": F.floor((F.col("_i") - 1) / size).cast("long")}), "_i").done()


def copy_last(df: DataFrame, keys, order, columns: dict[str, str]) -> DataFrame:
    """The value of each column one row before, by its new name (columns: new name -> column); empty at a key's first row."""
    line = Line.of(df, keys, order).scan(**{new: previous(F.coalesce(old, F.lit(""))) for new, old in columns.items()})
    return line.with_columns({new: F.coalesce(new, F.lit("")) for new in columns}).done()


def as_of(queries: DataFrame, times: DataFrame, keys: list[str], t: str, valid: str) -> DataFrame:
    """As `intervals.as_of`: the last time before is carried on, and the first one after is carried back."""
    q = queries.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_q"), F.struct(*queries.columns).alias("_row"))
    v = times.select(*keys, F.col(valid).alias("_t"), F.lit(0).alias("_q"), F.lit(None).cast(q.schema["_row"].dataType).alias("_row")).distinct()
    time = F.when(F.col("_q") == 0, F.col("_t"))
    line = Line.of(q.unionByName(v).withColumn("_u", F.monotonically_increasing_id()), keys, ["_t", "_q", "_u"]).scan(previous=carried(time), _after=carried(time, ahead=True))
    after = F.when(F.col("previous") == F.col("_t"), F.col("previous")).otherwise(F.col("_after"))  # an equal time stands before the query
    found = line.done().where("_q = 1").withColumn("following", after)
    nearest = F.when(F.col("previous").isNull(), F.col("following")).when(F.col("following").isNull(), F.col("previous")).when(F.col("following") - F.col("_t") < F.col("_t") - F.col("previous"), F.col("following")).otherwise(F.col("previous"))
    return found.select("_row.*", "previous", "following", nearest.alias("nearest"))


def with_memory(frames: DataFrame, keys: list[str], order: list[str], l0: str = "l0", l1: str = "l1", short_term: int = SHORT_TERM) -> DataFrame:
    """As `memory.with_memory`. The last changes are carried as arrays of at most `short_term` items.

    The keys that a group has shown, with the frame of each first one, are found by grouping and met with the group's frames;
    a frame's result names them, so they fit a row.
    """
    line = Line.of(frames, keys, order).scan(_was1=previous(F.struct(l1)), _was0=previous(F.struct(l0)), _pos=running(F.lit(1)))
    first = F.col("_pos") == 1
    events = F.concat(change_events(F.col(l1), F.col("_was1")[l1], first, "L1"), change_events(F.col(l0), F.col("_was0")[l0], first, "L0"))
    line = line.with_columns({"_ev": events}).scan(where=F.size(events) > 0, _tail=last_items(F.col("_ev"), short_term))
    line = line.scan(_last=carried(F.col("_tail"))).scan(_short=previous(F.col("_last")))
    rows, none = line.done(), F.array().cast("array<string>")
    shown = rows.select(*keys, "_pos", F.posexplode("_ev").alias("_i", "e")).where("e.sign = '+'").groupBy(*keys, F.col("e.key").alias("_shown")).agg(F.min(F.struct("_pos", "_i")).alias("at"))
    seen = shown.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", F.col("_shown").alias("key")))).alias("_seen"))
    older = F.transform(F.filter("_seen", lambda x: x["at"]["_pos"] < F.col("_pos")), lambda x: x["key"])
    short = F.transform("_short", lambda x: F.concat(x["sign"], x["key"]))
    met = rows.join(seen, keys, "left") if keys else rows.join(F.broadcast(seen))  # without keys one row, which a result holds
    return met.select(*frames.columns, F.coalesce(short, none).alias("short_term"), F.coalesce(older, none).alias("long_term"))
