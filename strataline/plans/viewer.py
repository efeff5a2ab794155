"""Tables that a viewer of recordings reads: scene graphs by second, valid times, and what it shows of a hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..operators.labels import drop_untimed, role_rank
from .hierarchy import tp_range


def scene_graphs(labels: DataFrame, frames: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """(take, ts, triplets) within a range of time points; of several time points of one second the last."""
    rows = tp_range(labels, start, end).join(frames.select("take", "tp_id", F.col("original_timestamp").alias("ts")), ["take", "tp_id"])
    return rows.where(F.col("ts").isNotNull()).groupBy("take", "ts").agg(F.max_by("triplets", "tp_id").alias("triplets"))


def valid_times(graphs: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """(take, role, ts): the seconds at which a role has something to show; role null: all seconds that have a graph.

    A person has those of graphs with it as a subject. With `roles` (take, role, is_robot, is_tool; as `shown_roles` gives them)
    only these are told of: a tool has those with it as a subject or an object, or all if there are none; a robot has all.
    """
    every = graphs.select("take", "ts")
    names = lambda *c: F.explode(F.array_distinct(F.concat(*(F.col(f"triplets.{x}") for x in c)))).alias("role")
    whole = every.select("take", F.lit(None).cast("string").alias("role"), "ts")
    if roles is None:
        return whole.unionByName(graphs.select("take", names("subj"), "ts"))
    known = roles.select("take", "role", F.when(F.col("is_robot"), "robot").when(F.col("is_tool"), "tool").otherwise("person").alias("kind")).distinct()
    of = lambda kind: known.where(F.col("kind") == kind).select("take", "role")
    people = graphs.select("take", names("subj"), "ts").join(of("person"), ["take", "role"], "left_semi")
    tools = graphs.select("take", names("subj", "obj"), "ts").join(of("tool"), ["take", "role"], "left_semi")
    unseen = of("tool").join(tools.select("take", "role").distinct(), ["take", "role"], "left_anti")
    always = of("robot").unionByName(unseen).join(every, "take").select("take", "role", "ts")
    return whole.unionByName(people).unionByName(tools).unionByName(always)


def shown_roles(l0: DataFrame, l1: DataFrame, l2: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(roles, l0, l1, l2): without untimed segments and the robot's set-up. roles: take, role, role_human, is_robot, is_tool,
    place (people, robots, tools, others; by name within each)."""
    tables = [t.where(F.col("role") != "robot_setup") for t in drop_untimed(l0, l1, l2, ["take", "role"])]
    role = F.col("role")
    names = l0.where(role != "robot_setup").select("take", "role").distinct().join(tables[0].groupBy("take", "role").agg(F.min_by("role_human", "ord").alias("role_human")), ["take", "role"], "left")
    rank = role_rank(role, V.ROLES, V.ROBOTS, V.TOOLS)
    roles = names.select("take", "role", F.coalesce("role_human", F.replace(role, F.lit("_"), F.lit(" "))).alias("role_human"), role.isin(*V.ROBOTS).alias("is_robot"), role.isin(*V.TOOLS).alias("is_tool"), F.struct(rank.alias("rank"), "role").alias("place"))
    return (roles, *tables)


def robot_timeline(l0: DataFrame, role: str = "robot_monitor") -> DataFrame:
    """(take, ord, time_start, time_end, label) of a robot's timed segments."""
    rows = l0.where((F.col("role") == role) & F.col("time_start").isNotNull() & F.col("time_end").isNotNull())
    items = F.col("active_predicates")
    label = T.robot_label(T.state_value(items, "Phase"), T.state_value(items, "Step"), " · ")
    return rows.select("take", "ord", "time_start", "time_end", label.alias("label"))
