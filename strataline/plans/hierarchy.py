"""From recording folders to a hierarchy: level 0 by runs of state, levels 1 and 2 by grouping. All takes are one plan."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..operators import intervals as J
from ..operators import islands as I
from ..operators import timeline as S
from ..operators.grouping import group_table
from ..operators.labels import role_rank
from ..sources import recordings as R
from ..sources.files import materialise
from ..sources.sinks import hierarchy_documents


def resolve_root(explicit: str | None, variable: str, candidates: list[str], local_first: bool = False) -> str:
    """Explicit path, else the environment variable, else the first folder that exists (in the order given, or reversed)."""
    for path in [explicit, os.environ.get(variable), *[c for c in (reversed(candidates) if local_first else candidates) if os.path.isdir(c)]]:
        if path:
            return path
    raise FileNotFoundError("no root folder of recordings")


def entries(labels: DataFrame, start_tp: str | None = None, max_frames: int | None = None) -> DataFrame:
    """Label rows from a time point on, at most `max_frames` per take; applied before any segmentation."""
    rows = labels.where(F.col("tp_id") >= start_tp) if start_tp else labels
    if max_frames is None:
        return rows
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("take").orderBy("tp_id"))).where(F.col("_n") <= max_frames).drop("_n")


def tp_range(labels: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Label rows from `start` to `end`, both included; an empty bound is none."""
    rows = labels.where(F.col("tp_id") >= start) if start else labels
    return rows.where(F.col("tp_id") <= end) if end else rows


def timelines(spark: SparkSession, root: str, labels: DataFrame, frames: DataFrame, tools: bool = True, robots: bool = True) -> DataFrame:
    """(take, tp_id, role, state) of people, tools and the robot."""
    triplets = labels.select("take", "tp_id", F.inline("triplets"))
    parts = [S.role_timeline(triplets)]
    if tools:
        parts.append(S.tool_timeline(triplets))
    if robots:
        phases = R.robot_phases(spark, root, labels.select("take"))
        parts.append(S.robot_timelines(labels, phases, R.screen_summaries(spark, root, frames)))
    return S.union_timelines(*parts)


def describe(role: Column, state: Column) -> Column:
    return F.when(role.isin(*V.ROBOTS), T.describe_robot(role, state)).when(role.isin(*V.TOOLS), T.describe_tool(role, state)).otherwise(T.describe_role(role, state))


def level0(timeline: DataFrame, frames: DataFrame, transcripts: DataFrame | None = None, debounce: int = 2) -> DataFrame:
    """Segments with ids, times (null where a time point is unmapped), description and the words said meanwhile."""
    seg = I.segments(timeline, ["take", "role"], "tp_id", "state", debounce)
    at = lambda c, name: frames.select("take", F.col("tp_id").alias(c), F.col("original_timestamp").alias(name))
    timed = seg.join(at("tp_start", "time_start"), ["take", "tp_start"], "left").join(at("tp_end", "time_end"), ["take", "tp_end"], "left")
    out = timed.select(
        "take", "role", F.col("segment").cast("int").alias("ord"), T.segment_id(F.col("role"), 0, F.col("segment")).alias("segment_id"), V.humanize(F.col("role")).alias("role_human"), F.lit(0).alias("level"),
        "tp_start", "tp_end", F.col("n_frames").alias("duration_frames"), F.col("state").alias("active_predicates"), "time_start", "time_end", T.duration(F.col("time_start"), F.col("time_end")).alias("duration_s"), describe(F.col("role"), F.col("state")).alias("description"),
    )
    none = F.array().cast("array<struct<start:double,end:double,text:string>>")
    if transcripts is None:
        return out.withColumn("transcript", none)
    said = J.overlap_lists(out.where("time_start is not null and time_end is not null"), transcripts, ["take"], "segment_id")
    return out.join(said, ["take", "segment_id"], "left").withColumn("transcript", F.coalesce("transcript", none))


def debounce_report(timeline: DataFrame, debounce: int = 2) -> DataFrame:
    """(take, role, raw, debounced, removed) of people."""
    people = timeline.where(F.col("role").isin(*V.ROLES))
    k = ["take", "role"]
    both = I.with_run(I.debounce(I.with_run(people, k, "tp_id", "state", "raw"), k, "tp_id", "state", debounce), k, "tp_id", "state")
    return both.groupBy(*k).agg(F.max("raw").alias("raw"), F.max("run").alias("debounced")).withColumn("removed", F.col("raw") - F.col("debounced"))


def debounce_analysis(timeline: DataFrame, frames: DataFrame, debounce: int = 2) -> DataFrame:
    """(take, debounce_analysis): segments before and after, the one-frame runs by category, and the counts of each role."""
    people = timeline.where(F.col("role").isin(*V.ROLES))
    counts = debounce_report(people, debounce).groupBy("take").agg(
        F.sum("raw").alias("raw"), F.sum("debounced").alias("debounced"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", F.struct("raw", "debounced", "removed").alias("v"))), lambda a, b: F.when(a["role"] < b["role"], -1).otherwise(1))).alias("per_role"),
    )
    timed = people.join(frames.select("take", "tp_id", F.col("original_timestamp").alias("ts")), ["take", "tp_id"], "left")
    noise = I.one_row_noise(timed, ["take", "role"], "ts", "state", "tp_id")
    kinds = noise.groupBy("take", "category").agg(F.count("*").alias("n"), F.min(F.struct("role", "tp_id")).alias("at"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("late"), "at", "category", "n")))
    total = kinds.groupBy("take").agg(F.sum("n").alias("one"), order.alias("kinds"))
    share = lambda k: F.struct(k["n"].alias("count"), F.round(100 * k["n"] / F.greatest(F.col("one"), F.lit(1)), 1).alias("percent"))
    both = counts.join(total, "take", "left").withColumn("one", F.coalesce("one", F.lit(0)))
    empty = F.expr("cast(map() as map<string,struct<count:bigint,percent:double>>)")
    kinds_map = F.coalesce(F.map_from_entries(F.transform("kinds", lambda k: F.struct(k["category"].alias("key"), share(k).alias("value")))), empty)
    found = F.struct(
        F.lit(debounce).alias("debounce"), F.col("raw").alias("segments_without_debounce"), F.col("debounced").alias("segments_with_debounce"), (F.col("raw") - F.col("debounced")).alias("segments_removed"),
        F.col("one").alias("one_frame_segments_analyzed"), kinds_map.alias("categories"), "per_role",
    )
    return both.select("take", found.alias("debounce_analysis"))


def metadata(tables: dict[str, DataFrame], labels: DataFrame, frames: DataFrame, root: str, debounce: int = 2) -> DataFrame:
    """(take, metadata): numbers of roles and segments, the recording's folder, and the range of its time points and times.

    Numbers of level-1 and level-2 segments are there if these levels are.
    """
    count = lambda t, name: t.groupBy("take").agg(F.count("*").alias(name))
    at = F.struct("tp_id", "original_timestamp")
    span = labels.select("take", "tp_id").distinct().join(frames.select("take", "tp_id", "original_timestamp"), ["take", "tp_id"], "left").groupBy("take").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("num_timepoints"))
    rows = tables["l0"].groupBy("take").agg(F.countDistinct("role").alias("total_roles"), F.count("*").alias("total_level0_segments")).join(span, "take", "left")
    names = ["total_roles", "total_level0_segments"]
    fields = [*names, F.lit(debounce).alias("debounce_frames"), F.concat(F.lit(f"{root.rstrip('/')}/"), "take").alias("take_dir"), F.array("a.tp_id", "b.tp_id").alias("tp_range"), "num_timepoints", F.array("a.original_timestamp", "b.original_timestamp").alias("time_range")]
    for level in (1, 2):
        if f"l{level}" in tables:
            name = f"total_level{level}_segments"
            rows = rows.join(count(tables[f"l{level}"], name), "take", "left")
            fields.append(F.coalesce(name, F.lit(0)).alias(name))
    return rows.select("take", F.struct(*fields).alias("metadata"))


def hashed_encoder(dimensions: int = 256) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors of hashed token counts: the default where no text encoder is plugged in."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dimensions] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def encoded(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], out: str = "vector") -> DataFrame:
    """Rows with the vector of a text, a batch at a time."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(encoder(s.fillna("").tolist())))

    return df.withColumn(out, run(F.col(text)))


def group_level(segments: DataFrame, level: int, threshold: float, encoder: Callable[[list[str]], np.ndarray] | None = None, text: str = "description") -> DataFrame:
    """Steps (level 1) or phases (level 2): neighbours stay together while their texts are within `threshold`.

    segments: take, role, ord, segment_id, time_start, time_end, `text`, transcript, and states (arrays of items) in `items`.
    """
    marked = I.adjacent_groups(encoded(segments, text, encoder or hashed_encoder()), ["take", "role"], "ord", "vector", threshold)
    packed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "segment_id", "time_start", "time_end", "items", "transcript"))), lambda x: x)
    rows = marked.groupBy("take", "role", F.col("group").cast("int").alias("ord")).agg(packed.alias("c"))
    start, end = F.element_at("c", 1)["time_start"], F.element_at("c", -1)["time_end"]
    items = F.array_distinct(F.flatten(F.transform("c", lambda x: x["items"])))
    return rows.select(
        "take", "role", "ord", T.segment_id(F.col("role"), level, F.col("ord")).alias("segment_id"), V.humanize(F.col("role")).alias("role_human"), F.lit(level).alias("level"), F.transform("c", lambda x: x["segment_id"]).alias("children"),
        start.alias("time_start"), end.alias("time_end"), T.duration(start, end).alias("duration_s"), T.describe_union(F.array(items)).alias("summary"), items.alias("items"), F.flatten(F.transform("c", lambda x: x["transcript"])).alias("transcript"),
    )


def model_level(segments: DataFrame, level: int, grouper, chunked: bool = True) -> DataFrame:
    """Steps or phases as a model groups them: children in the order of the segments, their times and all that was said.

    segments: take, role, ord, segment_id, time_start, time_end, transcript. Ids that the model invents have no children here;
    a group without any goes.
    """
    groups = group_table(segments, ["take", "role"], grouper, chunked)
    asked = groups.select("take", "role", F.col("ord").alias("group"), F.explode(F.array_distinct("segment_ids")).alias("segment_id"))
    child = F.struct("ord", "segment_id", "time_start", "time_end", "transcript")
    inner = segments.join(asked, ["take", "role", "segment_id"]).groupBy("take", "role", F.col("group").alias("ord")).agg(F.array_sort(F.collect_list(child)).alias("c"))
    rows = inner.join(groups.select("take", "role", "ord", "summary", "audio_summary"), ["take", "role", "ord"])
    start, end = F.element_at("c", 1)["time_start"], F.element_at("c", -1)["time_end"]
    return rows.select(
        "take", "role", "ord", T.segment_id(F.col("role"), level, F.col("ord")).alias("segment_id"), V.humanize(F.col("role")).alias("role_human"), F.lit(level).alias("level"), F.transform("c", lambda x: x["segment_id"]).alias("children"),
        start.alias("time_start"), end.alias("time_end"), T.duration(start, end).alias("duration_s"), "summary", "audio_summary", F.flatten(F.transform("c", lambda x: x["transcript"])).alias("transcript"),
    )


def build(spark: SparkSession, root: str, debounce: int = 2, thresholds: tuple[float, float] = (0.30, 0.45), start_tp: str | None = None, max_frames: int | None = None, tools: bool = True, encoder=None, groupers=None) -> dict[str, DataFrame]:
    """Tables l0, l1, l2, report, metadata and analysis of every take under `root` that can be processed.

    Levels 1 and 2 follow from text distances, or from two models if `groupers` has them (see grouping.group_table). Files are
    read once: labels, timelines and each level are written to the shared folder before what is above them reads them.
    """
    frames = materialise(R.frame_map(spark, root).join(R.takes(spark, root), "take", "left_semi"), "frames")
    labels = materialise(entries(R.relation_labels(spark, root, frames).join(frames.select("take").distinct(), "take", "left_semi"), start_tp, max_frames), "labels")
    line = materialise(timelines(spark, root, labels, frames, tools), "timelines")
    l0 = materialise(level0(line, frames, R.transcripts(spark, root), debounce), "l0")
    if groupers:
        l1 = materialise(model_level(l0, 1, groupers[0]), "l1")
        l2 = materialise(model_level(l1, 2, groupers[1], chunked=False), "l2")
    else:
        l1 = materialise(group_level(l0.withColumn("items", F.col("active_predicates")), 1, thresholds[0], encoder), "l1")
        l2 = materialise(group_level(l1, 2, thresholds[1], encoder, "summary"), "l2")
    tables = {"l0": l0, "l1": l1, "l2": l2}
    out = {**tables, "report": debounce_report(line, debounce), "metadata": metadata(tables, labels, frames, root, debounce)}
    return out | ({"analysis": debounce_analysis(line, frames, debounce)} if debounce > 1 else {})


def documents(tables: dict[str, DataFrame]) -> DataFrame:
    """(take, value): the hierarchy document of each take, from the tables of `build`."""
    steps = tables["l1"].drop("items").withColumnRenamed("children", "segment_ids")
    l0 = tables["l0"].withColumn("active_predicates", F.transform("active_predicates", lambda x: F.array(x["p"], x["o"])))
    return hierarchy_documents(l0, steps, tables["l2"].drop("items").withColumnRenamed("children", "child_ids"), tables.get("metadata"), tables.get("analysis"))


def ordered_roles(df: DataFrame) -> DataFrame:
    """People, robot screen, tools, then all others; by name within each."""
    return df.orderBy(role_rank(F.col("role"), V.ROLES, ("robot_monitor",), V.TOOLS), "role")


def frame_info(frames: DataFrame) -> DataFrame:
    """(take, tp_id, info): original_timestamp and the frame id of each camera that has one, as JSON."""
    return frames.select("take", "tp_id", F.to_json(F.struct("original_timestamp", *(F.col(k).alias(v) for k, v in V.CAMERAS.items()))).alias("info"))


def segment_prompt(role: Column, segments: Column, is_tool: Column, quotes: int = 5) -> Column:
    """The text of a grouping request: one line per segment with what was said, at most `quotes` quotes each.

    segments: array of struct segment_id, time_start, time_end, duration_s, description, transcript.
    """
    n = lambda c: F.coalesce(c.cast("string"), F.lit("None"))

    def speech(s: Column) -> Column:
        said = s["transcript"]
        text = F.array_join(F.transform(F.slice(said, 1, quotes), lambda t: F.concat(F.lit('"'), t["text"], F.lit('"'))), " / ")
        more = F.when(F.size(said) > quotes, F.concat(F.lit(" ... (+"), (F.size(said) - quotes).cast("string"), F.lit(" more)"))).otherwise("")
        return F.when(F.size(said) > 0, F.concat(text, more)).otherwise("—")

    def line(s: Column) -> Column:
        return F.concat(F.lit("  ["), s["segment_id"], F.lit("] t="), n(s["time_start"]), F.lit("s-"), n(s["time_end"]), F.lit("s ("), n(s["duration_s"]), F.lit("s): "), s["description"], F.lit("\n      Speech: "), speech(s))

    return _request(0, role, F.array_join(F.transform(segments, line), "\n"), is_tool)


# The parts of a grouping request that are the same for all, for segments (0) and for steps (1).
REQUEST = {
    0: ("Level-0 segments for ", " — when it is picked up, used, transferred between people, or idle.", "Group these into action steps. Output JSON only."),
    1: ("Level-1 action steps for ", ".", "Group these into surgical phases. Output JSON only."),
}
TOOL_NOTE = "\" is a surgical instrument/tool, not a person. Focus summaries on this tool's usage lifecycle"


def _request(level: int, role: Column, lines: Column, is_tool: Column) -> Column:
    head, more, ask = REQUEST[level]
    note = F.when(is_tool, F.concat(F.lit('Note: "'), V.humanize(role), F.lit(f"{TOOL_NOTE}{more}\n\n"))).otherwise("")
    return F.concat(F.lit(head), V.humanize(role), F.lit(":\n\n"), note, lines, F.lit(f"\n\n{ask}"))


def step_prompt(role: Column, steps: Column, is_tool: Column) -> Column:
    """The text of a request for phases: one line per step with its children's number, and what was said in it.

    steps: array of struct segment_id, time_start, time_end, duration_s, summary, audio_summary, children.
    """
    n = lambda c: F.coalesce(c.cast("string"), F.lit("?"))

    def line(s: Column) -> Column:
        heard = F.coalesce(F.nullif(s["audio_summary"], F.lit("")), F.lit("(no verbal communication)"))
        head = F.concat(F.lit("  ["), s["segment_id"], F.lit("] t="), n(s["time_start"]), F.lit("s-"), n(s["time_end"]), F.lit("s ("), n(s["duration_s"]), F.lit("s, "))
        return F.concat(head, F.size(s["children"]).cast("string"), F.lit(" L0 segments): "), F.coalesce(s["summary"], F.lit("")), F.lit("\n      Audio: "), heard)

    return _request(1, role, F.array_join(F.transform(steps, line), "\n"), is_tool)
