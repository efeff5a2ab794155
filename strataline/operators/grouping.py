"""Level-1 and level-2 groups: validation, merging of chunked answers, and folding of idle steps.

The grouping model itself is a plug-in: a function from the segments of one role to a list of groups
(dicts with segment_ids, summary, audio_summary), or None where it fails.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

CHUNK, OVERLAP = 30, 3
IDLE_SIMILARITY = 0.75


def validate_groups(groups: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, issue, detail) rows.

    groups: keys, ord, segment_ids array, summary. expected: keys, ids array (in order).
    """
    size = F.coalesce(F.size("segment_ids"), F.lit(0))
    empty = groups.where(size <= 0).select(*keys, F.lit("empty group").alias("issue"), F.lit("").alias("detail"))
    silent = groups.where((size > 0) & (F.coalesce("summary", F.lit("")) == "")).select(*keys, F.lit("missing summary").alias("issue"), F.element_at("segment_ids", -1).alias("detail"))
    ids = F.coalesce("segment_ids", F.array().cast("array<string>"))
    seen = groups.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", ids.alias("s")))), lambda x: x["s"])).alias("seen"))
    both = expected.join(seen, keys, "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    both = both.withColumn("missing", F.array_except("ids", "seen")).withColumn("extra", F.array_except("seen", "ids"))
    pick = lambda cond, name, detail: both.where(cond).select(*keys, F.lit(name).alias("issue"), detail.alias("detail"))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    order = pick((F.size("missing") == 0) & (F.size("extra") == 0) & (F.col("seen") != F.col("ids")), "out of order", F.lit(""))
    out = empty.unionByName(silent).unionByName(order)
    return out.unionByName(pick(F.size("missing") > 0, "missing segments", joined("missing"))).unionByName(pick(F.size("extra") > 0, "unknown segments", joined("extra")))


def merge_chunks(ids: list[str], answers: list[list[dict]], size: int = CHUNK, overlap: int = OVERLAP) -> list[dict]:
    """Groups of overlapping chunks as one list: ids that a chunk shares with the one before belong to the later chunk."""
    merged: list[dict] = []
    for number, groups in enumerate(answers):
        shared = set(ids[number * (size - overlap) :][:overlap]) if number else set()
        while merged and shared.intersection(merged[-1]["segment_ids"]):
            rest = [x for x in merged[-1]["segment_ids"] if x not in shared]
            if rest:
                merged[-1] = {**merged[-1], "segment_ids": rest}
                break
            merged.pop()
        merged += [dict(g) for g in groups]
    return merged


def group_segments(segments: pd.DataFrame, grouper: Callable[[pd.DataFrame], list[dict] | None], size: int = CHUNK, overlap: int = OVERLAP) -> list[dict] | None:
    """Groups of one role's segments (segment_id in order), in chunks if there are more than `size`; None if any call fails."""
    n = len(segments)
    if n <= size:
        return grouper(segments)
    starts = range(0, max(n - overlap, 1), size - overlap)
    answers = []
    for s in starts:
        got = grouper(segments.iloc[s : s + size])
        if got is None:
            return None
        answers.append(got)
        if s + size >= n:
            break
    return merge_chunks(segments["segment_id"].tolist(), answers, size, overlap)


def group_table(segments: DataFrame, keys: list[str], grouper: Callable[[pd.DataFrame], list[dict] | None], chunked: bool = True, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(keys, ord, segment_ids, summary, audio_summary): the groups that a model finds among each key's segments.

    The grouper sees the rows of one key in order of `ord`, in overlapping chunks unless not `chunked`. Ids are cleaned of
    white space and brackets. A key whose model call fails has no groups. A key's segments are those of one role in one
    recording, which the model reads at once.
    """
    schema = ", ".join(f"`{k}` {segments.schema[k].dataType.simpleString()}" for k in keys) + ", ord int, segment_ids array<string>, summary string, audio_summary string"
    names = [*keys, "ord", "segment_ids", "summary", "audio_summary"]
    ship_package(segments.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord").reset_index(drop=True)

        def ask(part: pd.DataFrame) -> list[dict] | None:
            found = grouper(part)
            return None if found is None else [{**g, "segment_ids": [str(x).strip().strip("[]") for x in g.get("segment_ids") or []]} for g in found]

        groups = group_segments(pdf, ask, size, overlap) if chunked else ask(pdf)
        rows = [{**{k: pdf[k].iloc[0] for k in keys}, "ord": i, "segment_ids": g["segment_ids"], "summary": g.get("summary") or "", "audio_summary": g.get("audio_summary") or ""} for i, g in enumerate(groups or [])]
        return pd.DataFrame(rows, columns=names)

    return segments.groupBy(*keys).applyInPandas(run, schema)


def fold_idle(steps: list[dict], idle: set[str], similarity: Callable[[str, str], float], threshold: float = IDLE_SIMILARITY) -> list[dict]:
    """Fold steps that hold one idle segment alone into their neighbours, from the left, until none is left.

    Between two steps that say much the same, all three become one; else, or at the end, the idle one joins the step before;
    at the start the one after. Each fold is seen by the next, so the rule is sequential within a role.
    """
    done: list[dict] = []
    todo = list(steps)
    alone = lambda s: len(s["segment_ids"]) == 1 and s["segment_ids"][0] in idle
    while todo:
        step = todo.pop(0)
        if not alone(step) or not (done or todo):
            done.append(step)
        elif not done:
            todo[0] = _joined([step, todo[0]], todo[0])
        elif todo and similarity(_says(done[-1]), _says(todo[0])) >= threshold:
            done[-1] = _joined([done[-1], step, todo.pop(0)], done[-1])
        else:
            done[-1] = _joined([done[-1], step], done[-1])
    return done


def _says(step: dict) -> str:
    return step.get("summary") or step.get("description") or ""


def _joined(parts: list[dict], anchor: dict) -> dict:
    heard = [p["audio_summary"] for p in parts if p.get("audio_summary")]
    start, end = parts[0].get("time_start"), parts[-1].get("time_end")
    return {
        "segment_ids": [x for p in parts for x in p["segment_ids"]],
        "time_start": start,
        "time_end": end,
        "summary": anchor.get("summary") or "",
        "audio_summary": "; ".join(heard) if heard else anchor.get("audio_summary") or "",
    }


def token_similarity(a: str, b: str) -> float:
    """Cosine of token counts: the default where no text encoder is plugged in."""
    x, y = pd.Series(a.lower().split()).value_counts(), pd.Series(b.lower().split()).value_counts()
    if not len(x) or not len(y):
        return 0.0
    return float((x.mul(y, fill_value=0)).sum() / ((x**2).sum() * (y**2).sum()) ** 0.5)


def _cosine(a: Column, b: Column) -> Column:
    """Cosine of the counts of two arrays of tokens; 0 if either is empty."""
    times = lambda x, t: F.size(F.filter(x, lambda y: y == t))
    dot = lambda x, y: F.aggregate(F.array_distinct(x), F.lit(0.0), lambda s, t: s + times(x, t) * times(y, t))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))).otherwise(0.0)


_STEP = "struct<segment_ids:array<string>,time_start:int,time_end:int,summary:string,audio_summary:string,tokens:array<string>>"


def _fold_by_tokens(steps: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """`fold_idle` with token_similarity as one fold over the ordered steps of each key, without Python.

    Its state is the steps that are done, the last one, a first idle step that waits for the one after it, and whether the next
    step belongs to the last. What a step says is that of its anchor, so tokens are made once.
    """
    tokens = F.filter(F.split(F.lower(F.coalesce("summary", F.lit(""))), r"(?U)\s+"), lambda t: t != "")
    item = F.struct("ord", F.struct("segment_ids", F.col("time_start").cast("int").alias("time_start"), F.col("time_end").cast("int").alias("time_end"), "summary", "audio_summary", tokens.alias("tokens")).cast(_STEP).alias("step"))
    rows = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_s"), F.flatten(F.collect_list("idle_ids")).alias("_idle"))
    alone = lambda x: (F.size(x["step"]["segment_ids"]) == 1) & F.array_contains("_idle", x["step"]["segment_ids"][0])
    rows = rows.withColumn("_s", F.transform("_s", lambda x, i: F.struct(x["step"].alias("step"), F.coalesce(alone(x), F.lit(False)).alias("alone"), F.get("_s", i + 1)["step"].alias("next"))))

    def joined(x: Column, y: Column, anchor: Column) -> Column:
        heard = F.filter(F.array(x["audio_summary"], y["audio_summary"]), lambda t: F.coalesce(t, F.lit("")) != "")
        said = F.when(F.size(heard) > 0, F.array_join(heard, "; ")).otherwise(F.coalesce(anchor["audio_summary"], F.lit("")))
        return F.struct(F.concat(x["segment_ids"], y["segment_ids"]).alias("segment_ids"), x["time_start"].alias("time_start"), y["time_end"].alias("time_end"), F.coalesce(anchor["summary"], F.lit("")).alias("summary"), said.alias("audio_summary"), anchor["tokens"].alias("tokens"))

    none = F.lit(None).cast(_STEP)

    def state(done: Column, last: Column, waits: Column, eats: Column) -> Column:
        return F.struct(done.alias("done"), last.alias("last"), waits.alias("waits"), eats.alias("eats"))

    def step(s: Column, x: Column) -> Column:
        waited, first, more = s["waits"].isNotNull(), s["last"].isNull(), x["next"].isNotNull()
        own = F.when(waited, joined(s["waits"], x["step"], x["step"])).otherwise(x["step"])
        idle = x["alone"] & ~waited
        longer = joined(s["last"], own, s["last"])
        done = F.when(first, s["done"]).otherwise(F.concat(s["done"], F.array(s["last"])))
        alike = more & (_cosine(s["last"]["tokens"], x["next"]["tokens"]) >= threshold)
        return (
            F.when(s["eats"], state(s["done"], longer, none, F.lit(False)))
            .when(~idle | (first & ~more), state(done, own, none, F.lit(False)))
            .when(first, state(s["done"], none, own, F.lit(False)))
            .otherwise(state(s["done"], longer, none, alike))
        )

    start = state(F.array().cast(f"array<{_STEP}>"), none, none, F.lit(False))
    folded = F.aggregate("_s", start, step, lambda s: F.concat(s["done"], F.array(s["last"])))
    out = rows.select(*keys, F.posexplode(folded).alias("ord", "s"))
    return out.select(*keys, "ord", *(F.col(f"s.{c}").alias(c) for c in ("segment_ids", "time_start", "time_end", "summary", "audio_summary")))


def fold_idle_steps(steps: DataFrame, keys: list[str], similarity=token_similarity, threshold: float = IDLE_SIMILARITY) -> DataFrame:
    """Steps per key with idle ones folded and numbered anew.

    steps: keys, ord, segment_ids array<string>, idle_ids array<string>, time_start, time_end int, summary, audio_summary.
    similarity: of two texts; Python runs only where one is plugged in.
    """
    if similarity is token_similarity:
        return _fold_by_tokens(steps, keys, threshold)
    ship_package(steps.sparkSession)
    schema = ", ".join(f"`{k}` {steps.schema[k].dataType.simpleString()}" for k in keys) + ", ord int, segment_ids array<string>, time_start int, time_end int, summary string, audio_summary string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        idle = {x for ids in pdf["idle_ids"] for x in ids}
        rows = [{**r, "segment_ids": list(r["segment_ids"])} for r in pdf[["segment_ids", "time_start", "time_end", "summary", "audio_summary"]].to_dict("records")]
        out = fold_idle(rows, idle, similarity, threshold)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "ord": i, **r} for i, r in enumerate(out)], columns=[*keys, "ord", "segment_ids", "time_start", "time_end", "summary", "audio_summary"])

    return steps.groupBy(*keys).applyInPandas(run, schema)


def first_groups(df: DataFrame, group: list[str], n: int | None) -> DataFrame:
    """The rows of the first n groups in key order, whole; a negative n is none, no n is all."""
    if n is None:
        return df
    chosen = df.select(*group).distinct().orderBy(*group).limit(max(n, 0))
    return df.join(chosen, group, "left_semi")


def incomplete_groups(samples: DataFrame, done: DataFrame, group: list[str], key: str = "id") -> DataFrame:
    """Samples of groups not all of whose ids are among the predictions: what a resumed run has still to do."""
    marked = samples.join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    whole = marked.groupBy(*group).agg(F.bool_and(F.coalesce("_done", F.lit(False))).alias("_all")).where("_all").select(*group)
    return samples.join(whole, group, "left_anti")
