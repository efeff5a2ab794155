"""Autoregressive prediction over frames, with the model as a plug-in."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import drop_speaker, strip_think
from ..session import ship_package
from .memory import SHORT_TERM, MemoryBuilder

GROUP = ["take", "role", "l2_segment_id"]


def memory_text(long: list[str], short: list[str]) -> str:
    parts = [f"{name}: {'; '.join(items)}" for name, items in (("Long", long), ("Short", short)) if items]
    return "<memory_start>\n" + "\n".join(parts) + "\n<memory_end>" if parts else ""


def split_output(text: str) -> tuple[str, str, str]:
    """(l0, l1, l2) of model output; the last part of a level wins."""
    found = {"L0": "", "L1": "", "L2": ""}
    for part in map(str.strip, text.split("|")):
        if part[:3] in ("L0:", "L1:", "L2:"):
            found[part[:2]] = part[3:].strip()
    return found["L0"], found["L1"], found["L2"]


def answer_batch(df: DataFrame, prompt: str, generate: Callable[[list[str]], list[str]], out: str = "answer") -> DataFrame:
    """Rows with the model's answer to each prompt, asked a batch at a time, without thoughts and a leading speaker line.

    generate: a list of prompts to a list of texts. A null prompt has no answer.
    """

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        ok = prompts.notna()
        said = pd.Series([None] * len(prompts), dtype=object)
        if ok.any():
            said[ok.to_numpy()] = list(generate(prompts[ok].tolist()))
        return said

    return df.withColumn(out, drop_speaker(strip_think(run(F.col(prompt)))))


class FrameLog:
    """The frames of one group in order: what to ask for the next one, and the rows of those that were answered."""

    def __init__(self, frames: list[dict], mode: str, fill_from_truth: bool, short_term: int):
        self.frames, self.mode, self.fill = frames, mode, fill_from_truth
        self.log, self.last, self.rows = MemoryBuilder(short_term), None, []

    @property
    def ended(self) -> bool:
        return len(self.rows) == len(self.frames)

    def request(self) -> tuple[list[str], str, str]:
        """(images, role, memory block) of the next frame; to be followed by its answer."""
        r = self.frames[len(self.rows)]
        long, short = self.log.before()
        if self.mode == "gt":
            self.log.record(r["gt_l0"] or "", r["gt_l1"] or "")
        elif self.mode == "predicted" and self.last is not None:
            self.log.record(*self.last)
        return list(r["image"] if r["image"] is not None else []), r["role_human"] or r["role"], memory_text(long, short) if self.mode != "none" else ""

    def answer(self, raw: str) -> None:
        r = self.frames[len(self.rows)]
        l0, l1, l2 = split_output(raw)
        self.last = (l0 or (r["gt_l0"] or "" if self.fill else ""), l1 or (r["gt_l1"] or "" if self.fill else ""))
        if self.mode == "predicted" and not self.rows:
            self.log.record(*self.last)
        self.rows.append({**{k: r[k] for k in ("id", "take", "role", "role_human", "tp_id", "l2_segment_id", "gt_l0", "gt_l1", "gt_l2")}, "pred_l0": l0, "pred_l1": l1, "pred_l2": l2, "raw_output": raw})


def predict(samples: DataFrame, generate: Callable[[list[str], str, str], str], mode: str = "predicted", fill_from_truth: bool = True, short_term: int = SHORT_TERM) -> DataFrame:
    """A prediction per sample, frame after frame within each (take, role, level-2 segment).

    samples: id, take, role, role_human, l2_segment_id, tp_id, image, gt_l0, gt_l1, gt_l2. generate(images, role, memory)
    returns text. Memory holds the truth of all earlier frames (mode "gt"), the model's own answers ("predicted"), or nothing
    ("none"). A frame's own answer enters the log when the frame after it has been asked; so from the third frame on the
    predicted memory is one frame behind. Where the model says nothing, `fill_from_truth` puts the truth in the log.
    """
    schema = "id string, take string, role string, role_human string, tp_id string, l2_segment_id string, pred_l0 string, pred_l1 string, pred_l2 string, raw_output string, gt_l0 string, gt_l1 string, gt_l2 string"

    ship_package(samples.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group = FrameLog(pdf.sort_values(["tp_id", "id"]).to_dict("records"), mode, fill_from_truth, short_term)
        while not group.ended:
            group.answer(generate(*group.request()))
        return pd.DataFrame(group.rows, columns=[c.split()[0] for c in schema.split(", ")])

    return samples.groupBy(*GROUP).applyInPandas(run, schema)
