"""Ordered work that no hot key can pile up in one task.

Rows are range-partitioned by key and order and written with their partition and place in it. A `Line` over them computes what
window functions over a whole key would: each partition works on its own stretch of a key, a summary of each partition's last
row (a row per partition, all that reaches the driver) is folded into what the partition is to carry on, and a second look
corrects the rows of the key that was cut. A key with all rows is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..sources.files import materialise

#: Bits of the row number within a partition in Spark's increasing ids.
_LOW = 33
#: Written partitions for each task that works on them, so that tasks get nearly equal numbers of rows.
_FINER = 4
#: Rows of one key from which a Line pays: two more passes over the rows, against one task for the key.
HOT_ROWS = 5_000_000


def _names(columns) -> list:
    return [columns] if isinstance(columns, str) else list(columns)


def lay_out(df: DataFrame, order, parts: int | None = None, part: str = "_part", at: str = "_at") -> DataFrame:
    """The rows as a written table, range-partitioned and sorted by `order`, with partition number and place within it.

    Rows equal in `order` meet in one partition: end it with a column that differs where many rows may be equal.
    """
    order = _names(order)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    table = materialise(placed, "ordered")
    return table.withColumn(part, F.shiftright(at, _LOW).cast("int")).withColumn(at, F.col(at).bitwiseAND((1 << _LOW) - 1))


def rank_all(df: DataFrame, order, name: str = "rank", parts: int | None = None) -> DataFrame:
    """The place of each row in the order of the whole table, from 0, without an unpartitioned window.

    Row counts of the partitions, one number each, are all that reaches the driver.
    """
    table = lay_out(df, order, parts)
    sizes = sorted((r["_part"], r["count"]) for r in table.groupBy("_part").count().collect())
    base, below = [], 0
    for part, n in sizes:
        base.append((part, below))
        below += n
    bases = F.broadcast(df.sparkSession.createDataFrame(base, "_part int, _base long"))  # a row per partition
    return table.join(bases, "_part").withColumn(name, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def largest_key(df: DataFrame, keys) -> int:
    """Rows of the commonest key."""
    return df.groupBy(*_names(keys)).count().agg(F.max("count")).first()[0] or 0


# ---------------------------------------------------------------- scans


@dataclass(frozen=True)
class Scan:
    """A column that follows from the rows before (or after) in the key.

    local: over a window of one partition's rows of the key. join: what a partition has, given what came before it, for columns;
    fold: the same for values. ahead: the rows after count instead of those before. shifted: for a shift by one row, what is
    shifted; the column itself goes on otherwise.
    """

    local: Callable[[object], Column]
    join: Callable[[Column, Column], Column]
    fold: Callable[[object, object], object]
    ahead: bool = False
    shifted: Column | None = None


def previous(value) -> Scan:
    """The value one row before; null at the key's first row."""
    value = F.col(value) if isinstance(value, str) else value
    return Scan(lambda w: F.lag(value).over(w), lambda before, own: before, lambda before, own: own, shifted=value)


def following(value) -> Scan:
    """The value one row after; null at the key's last row."""
    return replace(previous(value), ahead=True)


def running(value) -> Scan:
    """The sum up to and with the row."""
    return Scan(lambda w: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), lambda before, own: F.coalesce(before, F.lit(0)) + own, lambda before, own: (before or 0) + own)


def carried(value: Column, ahead: bool = False) -> Scan:
    """The last value that is not null, up to and with the row (ahead: the next one, from the row on)."""
    return Scan(
        lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), lambda before, own: F.coalesce(own, before), lambda before, own: before if own is None else own, ahead
    )


def last_items(value: Column, n: int) -> Scan:
    """The last n items of an array column over the rows up to and with this one; rows should have an item each (see `Line.where`)."""
    tail = lambda a: F.slice(a, F.greatest(F.size(a) - (n - 1), F.lit(1)), n)
    return Scan(
        lambda w: tail(F.flatten(F.collect_list(value).over(w.rowsBetween(1 - n, 0)))),
        lambda before, own: F.when(before.isNull() | (F.size(own) >= n), own).otherwise(tail(F.concat(before, own))),
        lambda before, own: [*(before or []), *own][-n:],
    )


@dataclass(frozen=True)
class Line:
    """Rows of keys in order, spread evenly; `rows` has two columns of its own, `_part` and `_at`."""

    rows: DataFrame
    keys: tuple

    @staticmethod
    def of(df: DataFrame, keys, order, parts: int | None = None) -> Line:
        """Lay rows out. Rows equal in keys and order stay in one task."""
        keys, order = _names(keys), _names(order)
        parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return Line(lay_out(df, [*keys, *order], _FINER * parts).repartitionByRange(parts, "_part"), tuple(keys))

    def select(self, *columns) -> Line:
        return Line(self.rows.select(*columns, "_part", "_at"), self.keys)

    def with_columns(self, columns: dict[str, Column]) -> Line:
        return Line(self.rows.withColumns(columns), self.keys)

    def done(self) -> DataFrame:
        return self.rows.drop("_part", "_at")

    def scan(self, where: Column | None = None, **scans: Scan) -> Line:
        """Add a column per scan. where: rows that the scans see; the others get null."""
        rows, key = self.rows, F.struct(*self.keys) if self.keys else F.struct(F.lit(0).alias("all"))
        seen = where if where is not None else F.lit(True)
        if where is not None:
            rows = rows.withColumn("_seen", F.coalesce(where, F.lit(False)))
            seen = F.col("_seen")
        groups = ["_part", *self.keys, *(["_seen"] if where is not None else [])]
        for name, s in scans.items():
            w = Window.partitionBy(*groups).orderBy(F.desc("_at") if s.ahead else F.asc("_at"))
            rows = rows.withColumn(name, F.when(seen, s.local(w)))
            if s.shifted is not None:
                rows = rows.withColumn(f"_first_{name}", F.lag(F.lit(True)).over(w).isNull())
        rows = rows.withColumn("_key", key)
        spark, types = rows.sparkSession, {n: rows.schema[n].dataType for n in scans}
        at = F.when(seen, F.col("_at"))
        # the value that goes on: that of the edge row, for a shift the row's own
        edge = lambda s: F.min_by if s.ahead else F.max_by
        gone = {n: F.col(n) if s.shifted is None else s.shifted for n, s in scans.items()}
        ends = rows.groupBy("_part").agg(F.min_by("_key", at).alias("low"), F.max_by("_key", at).alias("high"), F.max(at).alias("some"), *(edge(s)(gone[n], at).alias(n) for n, s in scans.items())).collect()
        ends = sorted((r for r in ends if r["some"] is not None), key=lambda r: r["_part"])
        carry: dict[int, dict] = {r["_part"]: {} for r in ends}
        for n, s in scans.items():
            before = None
            for r in reversed(ends) if s.ahead else ends:
                near, far = (r["high"], r["low"]) if s.ahead else (r["low"], r["high"])
                value = r[n]
                if before is not None and before[0] == near:
                    carry[r["_part"]][n] = before[1]
                    if far == near:
                        value = s.fold(before[1], value)
                before = (far, value)
        low, high = {r["_part"]: r["low"] for r in ends}, {r["_part"]: r["high"] for r in ends}
        kind = rows.schema["_key"].dataType
        schema = Ty.StructType([Ty.StructField("_part", Ty.IntegerType()), Ty.StructField("_low", kind), Ty.StructField("_high", kind), *(f for n in scans for f in (Ty.StructField(f"_has_{n}", Ty.BooleanType()), Ty.StructField(f"_carry_{n}", types[n])))])
        told = [(p, low[p], high[p], *(x for n in scans for x in (n in c, c.get(n)))) for p, c in carry.items() if c]
        if told:
            rows = rows.join(F.broadcast(spark.createDataFrame(told, schema)), "_part", "left")  # at most a row per partition
            for n, s in scans.items():
                cut = F.col(f"_has_{n}") & F.col("_key").eqNullSafe(F.col("_high" if s.ahead else "_low")) & seen
                if s.shifted is not None:
                    cut = cut & F.col(f"_first_{n}")
                rows = rows.withColumn(n, F.when(F.coalesce(cut, F.lit(False)), s.join(F.col(f"_carry_{n}"), F.col(n))).otherwise(F.col(n)))
        own = {"_key", "_seen", "_low", "_high", *(f"{p}{n}" for n in scans for p in ("_has_", "_carry_", "_first_"))}
        return Line(rows.drop(*own), self.keys)
