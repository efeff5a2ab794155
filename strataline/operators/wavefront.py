"""Autoregressive prediction of many groups at once, committed group by group, so that a run that ends early is resumed.

A frame needs the answers to the frames before it in its group, but groups are independent: a task keeps up to `wave` groups
open and asks the next frame of all of them in one call of the model; a group that is through makes room for the next. Finished
groups are written in bundles under a temporary name and renamed, so that what is there is whole groups. A task that is
repeated passes over the bundles that it finds, and a run that is repeated over the groups that earlier runs finished.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from ..sources import files
from ..sources.recordings import PREDICTION
from .grouping import incomplete_groups
from .inference import GROUP, FrameLog
from .memory import SHORT_TERM

#: What the model is asked for a frame: image paths, role, memory block.
Request = tuple[list[str], str, str]
#: Groups that a task has open, and finished ones that it writes at once.
WAVE, BUNDLE = 256, 64


def groups_of(frames: Iterator[pd.DataFrame]) -> Iterator[list[dict]]:
    """The frames of one group after the other, from sorted batches."""
    held: list[dict] = []
    for part in frames:
        for r in part.to_dict("records"):
            if held and any(held[0][k] != r[k] for k in GROUP):
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def wavefront(groups: Iterator[list[dict]], ask: Callable[[list[Request]], list[str]], mode: str, fill_from_truth: bool, short_term: int, wave: int) -> Iterator[list[dict]]:
    """The prediction rows of each group as it ends. A call asks a frame of every open group."""
    still: list[FrameLog] = []
    more = True
    while more or still:
        while more and len(still) < wave:
            new = next(groups, None)
            more = new is not None
            if more:
                still.append(FrameLog(new, mode, fill_from_truth, short_term))
        if not still:
            return
        said = ask([g.request() for g in still])
        if len(said) != len(still):
            raise ValueError(f"the model gave {len(said)} answers to {len(still)} frames")
        for g, raw in zip(still, said, strict=True):
            g.answer(raw)
        for g in still:
            if g.ended:
                yield g.rows
        still = [g for g in still if not g.ended]


class PredictionRuns:
    """The predictions below `root` in a shared folder: a folder per run, in it bundles of finished groups as JSON lines."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        ship_package(spark)

    def _lines(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/run=*/*.jsonl")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not len(fs.globStatus(at) or []):
            return None
        return self.spark.read.schema(PREDICTION).option("basePath", self.root).json(f"{self.root}/run=*/*.jsonl")

    def rows(self) -> DataFrame:
        """The predictions of every group by the last run that finished it."""
        lines = self._lines()
        if lines is None:
            return self.spark.createDataFrame([], PREDICTION)
        last = lines.groupBy(*GROUP).agg(F.max("run").alias("run"))
        return lines.join(last, [*GROUP, "run"], "left_semi").drop("run")

    def run(self, samples: DataFrame, ask: Callable[[list[Request]], list[str]], mode: str = "predicted", fill_from_truth: bool = True, short_term: int = SHORT_TERM, wave: int = WAVE, bundle: int = BUNDLE) -> int:
        """Predict the groups of which not every sample has a prediction yet; returns how many. Raises what the model raises.

        samples as `inference.predict` takes them. ask: as many texts as requests; it must give a repeated task the same texts
        for its bundles to be the same.
        """
        if mode not in ("gt", "predicted", "none"):
            raise ValueError(f"mode must be gt, predicted or none, not {mode}")
        todo = incomplete_groups(samples, self.rows(), GROUP)
        lines = self._lines()
        number = 1 if lines is None else (lines.agg(F.max("run")).first()[0] or 0) + 1
        folder = f"{self.root}/run={number:06d}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        spread = todo.repartition(parts, *GROUP).sortWithinPartitions(*GROUP, "tp_id", "id")
        done = spread.mapInPandas(partial(_work, folder, ask, mode, fill_from_truth, short_term, wave, bundle), "n long")
        return done.groupBy().sum("n").first()[0] or 0


def _work(folder: str, ask, mode: str, fill_from_truth: bool, short_term: int, wave: int, bundle: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    store, top = files.store(folder)
    part, number, before = TaskContext.get().partitionId(), 0, set()
    while (text := files.read_text(store, f"{top}/part-{part:06d}-{number:06d}.jsonl")) is not None:
        before |= {tuple(json.loads(line)[k] for k in GROUP) for line in text.splitlines()}  # an attempt before this one
        number += 1
    open_groups = (g for g in groups_of(frames) if tuple(g[0][k] for k in GROUP) not in before)
    held, n = [], 0
    names = [c.split()[0] for c in PREDICTION.split(", ")]

    def commit() -> None:
        body = "".join(json.dumps({k: r[k] for k in names}, ensure_ascii=False) + "\n" for g in held for r in g)
        files.write_text(store, f"{top}/part-{part:06d}-{number:06d}.jsonl", body)

    for rows in wavefront(open_groups, ask, mode, fill_from_truth, short_term, wave):
        held.append(rows)
        if len(held) == bundle:
            commit()
            n, number, held = n + len(held), number + 1, []
    if held:
        commit()
        n += len(held)
    yield pd.DataFrame({"n": [n + len(before)]})
