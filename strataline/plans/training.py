"""Training samples from hierarchies in one call: time points, labels, memory, images, prompts and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..operators import hotkeys as H
from ..operators import labels as B
from ..operators import memory as Y
from ..sources import sinks as K


def frames_of_phases(tables: dict[str, DataFrame]) -> DataFrame:
    """(take, role, l2_segment_id, tp, role_human, l0, l1, l2 and their ids): the labelled time points of every phase."""
    keys = ["take", "role"]
    whole = tables["l0"].withColumns({c: F.col(c).cast("long") for c in ("tp_start", "tp_end")})
    levels = (whole, tables["l1"], tables["l2"])
    points = B.time_points(*levels, keys).withColumnRenamed("l2_id", "l2_segment_id")
    human = tables["l0"].groupBy(*keys).agg(F.min_by("role_human", "ord").alias("role_human"))
    return points.join(B.frame_labels(*levels, keys), [*keys, "tp"]).join(human, keys).withColumn("role_human", F.coalesce("role_human", "role"))


def build_samples(
    tables: dict[str, DataFrame], frames: DataFrame | None = None, images: DataFrame | None = None, seed: int | None = None, splits: dict[str, str] | None = None, default: str = "train", spread: bool = False
) -> DataFrame:
    """A sample per labelled frame of every phase, with its split, as `sinks.write_splits` takes them.

    tables: l0, l1, l2 as `hierarchy.build` gives them. frames: the frame map; a frame without an image id has no sample, but
    counts for the memory of those after it. images: (take, path) of the image files; all views of a sample must be among them.
    Without frames, as in a dry run, views are named after the time point. seed: thin the memory out by chance, by the sample's
    id. splits: recording to split, by default those of the data set; others go to `default`. spread: phases may be so long that
    one task must not sort them.
    """
    rows = frames_of_phases(tables)
    group = ["take", "role", "l2_segment_id"]
    told = (H.with_memory if spread else Y.with_memory)(rows, group, ["tp"]).withColumn("tp_id", F.lpad(F.col("tp").cast("string"), 6, "0"))
    told = told.withColumn("id", F.concat_ws("/", *group, "tp_id"))
    cameras = tuple(V.CAMERAS.values())
    if frames is None:
        seen = told.withColumn("image", T.image_paths(F.col("tp"), cameras))
    else:
        known = frames.where("azure is not null").select("take", "tp_id", T.image_paths(F.col("azure").cast("long"), cameras).alias("image"))
        seen = told.join(known, ["take", "tp_id"])
    if images is not None:
        missing = seen.select("id", "take", F.explode("image").alias("path")).join(images.select("take", "path"), ["take", "path"], "left_anti").select("id").distinct()
        seen = seen.join(missing, "id", "left_anti")
    long, short = F.col("long_term"), F.col("short_term")
    memory = T.memory_string(long, short) if seed is None else T.augment_memory(seed, F.col("id"), long, short)
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    talk = F.array(turn("human", T.prompt(F.col("role_human"), memory)), turn("gpt", T.answer(F.col("l0"), F.col("l1"), F.col("l2"))))
    made = seen.select(
        "id", "image", "take", "role", "role_human", "l2_segment_id", "tp_id", talk.alias("conversations"), *(F.col(f"l{i}").alias(f"gt_l{i}") for i in range(3)), *(F.col(f"l{i}_id").alias(f"gt_l{i}_seg_id") for i in range(3))
    )
    table = {t: name for name, takes in V.TAKE_SPLITS.items() for t in takes} if splits is None else splits
    return K.with_split(made, table, default)
