"""A data source of label files that opens only those that matter.

A recording's label files are planned from listings: a partition is a slice of one recording, and few recordings are cut into
as many slices as there are tasks at a time. Files are handed on by number and size, however large they are. Filters on recording and time
point are matched against names, and a file to which no entry of the recording's frame map belongs is told of (`mapped` is
false) but not opened; a file that cannot be read only matters if it is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from ..session import ship_package
from . import files

NAME = "recording_labels"
#: Files whose contents are handed on at once, and their characters from which fewer are.
_BATCH = 500
_LETTERS = 4 << 20


def _test(f: D.Filter):
    """What a pushed filter asks of a name; None for what is left to Spark."""
    if isinstance(f, D.EqualTo):
        return lambda x: x == f.value
    if isinstance(f, D.In):
        return lambda x: x in f.value
    if isinstance(f, D.GreaterThanOrEqual):
        return lambda x: x >= f.value
    if isinstance(f, D.GreaterThan):
        return lambda x: x > f.value
    if isinstance(f, D.LessThanOrEqual):
        return lambda x: x <= f.value
    if isinstance(f, D.LessThan):
        return lambda x: x < f.value
    if isinstance(f, D.StringStartsWith):
        return lambda x: x.startswith(f.value)
    return None


class LabelPartition(D.InputPartition):
    def __init__(self, take: str, part: int, of: int):
        super().__init__((take, part))
        self.take, self.part, self.of = take, part, of


class LabelReader(D.DataSourceReader):
    def __init__(self, options):
        self.root, self.slices, self.tasks = options["path"].rstrip("/"), int(options.get("slices", "0")), int(options.get("tasks", "1"))
        self.tests: dict[str, list] = {"take": [], "tp_id": []}

    def partitions(self):
        from pyarrow.fs import FileSelector, FileType

        at, top = files.store(self.root)
        names = sorted(x.base_name for x in at.get_file_info(FileSelector(top)) if x.type == FileType.Directory)
        names = [n for n in names if all(t(n) for t in self.tests["take"])]
        slices = self.slices or -(-self.tasks // max(len(names), 1))
        return [LabelPartition(n, i, slices) for n in names for i in range(slices)]

    def read(self, partition: LabelPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector

        at, top = files.store(self.root)
        top = f"{top}/{partition.take}"
        names = sorted(x.base_name[:-5] for x in at.get_file_info(FileSelector(f"{top}/relation_labels", allow_not_found=True)) if x.base_name.endswith(".json"))
        mine = [n for n in names[partition.part :: partition.of] if all(t(n) for t in self.tests["tp_id"])]
        if not mine:
            return
        try:
            frames = len(json.loads(files.read_text(at, f"{top}/timestamp_to_pcd_and_frames_list.json") or "[]"))
        except ValueError:
            frames = 0
        rows, letters = [], 0
        for name in mine:
            mapped = name.isascii() and name.isdigit() and len(name) == max(6, len(str(int(name)))) and int(name) < frames
            rows.append((partition.take, name, mapped, files.read_text(at, f"{top}/relation_labels/{name}.json") if mapped else None))
            letters += len(rows[-1][3] or "")
            if len(rows) == _BATCH or letters >= _LETTERS:
                yield _batch(rows)
                rows, letters = [], 0
        if rows:
            yield _batch(rows)


class FilteringReader(LabelReader):
    """With filters on names; Spark wants it only where the session pushes filters to Python."""

    def pushFilters(self, filters: list[D.Filter]):  # noqa: N802
        for f in filters:
            test = _test(f) if f.__class__ is not D.IsNotNull and getattr(f, "attribute", ())[:1] in (("take",), ("tp_id",)) else None
            if test is None:
                yield f
            else:
                self.tests[f.attribute[0]].append(test)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["take", "tp_id", "mapped", "value"])


class LabelSource(D.DataSource):
    """take, tp_id, mapped, value of the label files below `path`; slices: partitions of a recording (0: as many as give
    `tasks` partitions in all); push: are filters pushed."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "take string, tp_id string, mapped boolean, value string"

    def reader(self, schema) -> LabelReader:
        return (FilteringReader if self.options.get("push") == "true" else LabelReader)(self.options)


def reachable(root: str) -> bool:
    """Whether Python reaches the store that `root` is in; others only Spark reads."""
    try:
        files.store(root)
    except (ValueError, OSError, NotImplementedError):
        return False
    return True


def label_files(spark: SparkSession, root: str, slices: int | None = None) -> DataFrame:
    """take, tp_id, mapped and value of label files. slices: partitions of a recording, by default enough for all tasks. Filters on take and tp_id are pushed if the session allows it now and when
    the rows are read (`spark.sql.python.filterPushdown.enabled`)."""
    ship_package(spark)
    spark.dataSource.register(LabelSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(NAME).option("slices", str(slices or 0)).option("tasks", str(spark.sparkContext.defaultParallelism)).option("push", push).load(root)
