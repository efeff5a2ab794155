"""Temporal memory: what a model is told about the frames before the current one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHORT_TERM = 5


def change_events(new: Column, old: Column, first: Column, level: str) -> Column:
    """Change events of one level at a frame: -old then +new; at the first frame +new if it says anything."""
    event = lambda sign, text: F.struct(F.lit(sign).alias("sign"), F.concat(F.lit(f"{level}:"), text).alias("key"))
    none = F.array().cast("array<struct<sign:string,key:string>>")
    return F.when(first, F.when(new != "", F.array(event("+", new))).otherwise(none)).when(new != old, F.array(event("-", old), event("+", new))).otherwise(none)


def with_memory(frames: DataFrame, keys: list[str], order: list[str], l0: str = "l0", l1: str = "l1", short_term: int = SHORT_TERM) -> DataFrame:
    """Frames with `long_term` (keys in first-seen order) and `short_term` (last changes), both from earlier frames only.

    The last changes before a frame lie in the last `short_term` frames that have any, so a short window over those gives
    them. What a group has seen is a list of its distinct keys with the frame that showed them first, built once per group;
    a frame takes the part of it that is older. Work grows with frames times distinct keys, as the result does.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.lag(F.lit(True)).over(w).isNull()
    events = F.concat(change_events(F.col(l1), F.lag(l1).over(w), first, "L1"), change_events(F.col(l0), F.lag(l0).over(w), first, "L0"))
    staged = frames.withColumn("_ev", events).withColumn("_pos", F.row_number().over(w))
    some = staged.withColumn("_some", F.size("_ev") > 0)
    near = F.flatten(F.collect_list("_ev").over(Window.partitionBy(*keys, "_some").orderBy(*order).rowsBetween(1 - short_term, 0)))
    tail = F.slice(near, F.greatest(F.size(near) - (short_term - 1), F.lit(1)), short_term)
    some = some.withColumn("_tail", F.when(F.col("_some"), F.transform(tail, lambda x: F.concat(x["sign"], x["key"]))))
    none = F.array().cast("array<string>")
    short = F.coalesce(F.last("_tail", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), none)
    shown = staged.select(*keys, "_pos", F.posexplode("_ev").alias("_i", "e")).where("e.sign = '+'").groupBy(*keys, F.col("e.key").alias("_shown")).agg(F.min(F.struct("_pos", "_i")).alias("at"))
    seen = shown.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", F.col("_shown").alias("key")))).alias("_seen"))
    older = F.transform(F.filter("_seen", lambda x: x["at"]["_pos"] < F.col("_pos")), lambda x: x["key"])
    joined = some.withColumn("short_term", short).join(seen, keys, "left")
    return joined.select(*frames.columns, "short_term", F.coalesce(older, none).alias("long_term"))


class MemoryBuilder:
    """The same, frame by frame: for models whose own answers are the state."""

    def __init__(self, short_term: int = SHORT_TERM):
        self.short_term, self.log, self.seen, self.last = short_term, [], {}, None

    def before(self) -> tuple[list[str], list[str]]:
        """(long_term, short_term) of all frames recorded so far."""
        return list(self.seen), [s + k for s, k in self.log[-self.short_term :]]

    def record(self, l0: str, l1: str) -> None:
        for level, new, old in (("L1", l1, self.last and self.last[1]), ("L0", l0, self.last and self.last[0])):
            if self.last is None:
                changes = [("+", new)] if new else []
            else:
                changes = [("-", old), ("+", new)] if new != old else []
            for sign, text in changes:
                self.log.append((sign, f"{level}:{text}"))
                if sign == "+":
                    self.seen.setdefault(f"{level}:{text}")
        self.last = (l0, l1)
