"""Timelines: per time point, the set of items that hold for a role, tool or robot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab


def state_set(items: Column) -> Column:
    """A set in canonical form: sorted and distinct, so that equal sets are equal arrays. Nulls are not items."""
    return F.array_sort(F.collect_set(items))


def role_timeline(triplets: DataFrame, keys=("take", "tp_id"), roles=vocab.ROLES, active=vocab.ACTIVE) -> DataFrame:
    """(keys, role, state): a row where the role is subject of any triplet; only active predicates enter the state.

    triplets: keys, subj, pred, obj.
    """
    item = F.when(F.col("pred").isin(*active), F.struct(F.col("pred").alias("p"), F.col("obj").alias("o")))
    return triplets.where(F.col("subj").isin(*roles)).groupBy(*keys, F.col("subj").alias("role")).agg(state_set(item).alias("state"))


def tool_timeline(triplets: DataFrame, keys=("take", "tp_id"), tools=vocab.TOOLS, active=vocab.ACTIVE, verb_tool: dict[str, str] = vocab.VERB_TOOL) -> DataFrame:
    """(keys, role, state) of tools: handled as object, or implied by a verb whatever its object; both may hold at once."""
    by_object = F.struct(F.lit(False).alias("verb"), F.when(F.col("obj").isin(*tools), F.col("obj")).alias("role"))
    by_verb = F.struct(F.lit(True).alias("verb"), vocab.lookup(F.col("pred"), verb_tool).alias("role"))
    rows = triplets.select(*keys, "subj", "pred", F.inline(F.array(by_object, by_verb))).where(F.col("role").isNotNull())
    item = F.when(F.col("verb") | F.col("pred").isin(*active), F.struct(F.col("pred").alias("p"), F.col("subj").alias("o")))
    return rows.groupBy(*keys, "role").agg(state_set(item).alias("state"))


def robot_state(phase: Column, step: Column | None = None) -> Column:
    """{(Phase, p)} or {(Phase, p), (Step, s)}; empty strings count as missing."""
    item = lambda name, v: F.when(v.isNotNull() & (v != ""), F.struct(F.lit(name).alias("p"), v.alias("o")))
    return F.array_compact(F.array(item("Phase", phase), *([item("Step", step)] if step is not None else [])))


def robot_timelines(entries: DataFrame, phases: DataFrame, screens: DataFrame, keys=("take", "tp_id")) -> DataFrame:
    """Timelines of robot_setup (phases: keys, phase) and robot_monitor (screens: keys, phase, step) over the entries' time points."""
    points = entries.select(*keys).distinct()
    setup = points.join(phases, list(keys)).select(*keys, F.lit("robot_setup").alias("role"), robot_state(F.col("phase")).alias("state"))
    monitor = points.join(screens, list(keys)).select(*keys, F.lit("robot_monitor").alias("role"), robot_state(F.col("phase"), F.col("step")).alias("state"))
    return setup.unionByName(monitor).where(F.size("state") > 0)


def screen_choice(readings: DataFrame, keys, order) -> DataFrame:
    """Phase and step of the highest certainty (a number or text) per key; of equals the first in `order`.

    readings: keys, order columns, name, type, certainty. Certainties that are no number count as 0; -1 or less never wins.
    """
    sure = F.coalesce(F.col("certainty").try_cast("double"), F.lit(0.0))
    rows = readings.where(F.col("type").isin("phase", "current_step")).withColumn("_c", sure).where(F.col("_c") > -1)
    first = F.struct((-F.col("_c")).alias("c"), *order)
    best = lambda kind: F.min_by(F.when(F.col("type") == kind, F.col("name")), F.when(F.col("type") == kind, first))
    return rows.groupBy(*keys).agg(best("phase").alias("phase"), best("current_step").alias("step"))


def union_timelines(*timelines: DataFrame) -> DataFrame:
    out = timelines[0]
    for t in timelines[1:]:
        out = out.unionByName(t)
    return out
