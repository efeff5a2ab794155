"""The folder that driver and executors share, and files written whole by executors."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package

_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts of files that a worker holds at once.
_TEXTS = 8


def shared_root(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; on one machine, where it names none, a default of our own."""
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{key} must name a folder that driver and executors share")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path((found or "file:///tmp/checkpoints/strataline").rstrip("/"))
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def scratch(spark: SparkSession, name: str) -> str:
    """A new shared folder that goes with the application."""
    out = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return out


def store(uri: str):
    """A file system that executors reach without Spark, and the path in it; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_text(at, path: str, text: str) -> None:
    """Write a file under a temporary name in its folder, then rename: readers see whole files only."""
    folder, _, name = path.rpartition("/")
    at.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
    with at.open_output_stream(temporary) as out:
        out.write(text.encode())
    at.move(temporary, path)


def read_text(at, path: str) -> str | None:
    """A file's text, or None if there is none."""
    try:
        with at.open_input_file(path) as f:
            return f.read().decode()
    except FileNotFoundError:
        return None


@contextmanager
def small_batches(spark: SparkSession, rows: int = _TEXTS):
    """Actions within hand a worker few rows at a time: for rows that may be large."""
    before = spark.conf.get(_RECORDS, None)
    spark.conf.set(_RECORDS, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(_RECORDS) if before is None else spark.conf.set(_RECORDS, before)


def write_files(rows: DataFrame, root: str) -> int:
    """Write each row (path, value) as the text file root/path, under a temporary name first; returns how many there are.

    Executors write, so a value must fit one of them; a worker holds a few. A repeated task ends in the same files.
    """
    ship_package(rows.sparkSession)

    def run(batches):
        at, top = store(root)
        for b in batches:
            for path, value in zip(b.column("path"), b.column("value"), strict=True):  # a text at a time as Python's
                write_text(at, f"{top}/{path.as_py()}", value.as_py() or "")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    with small_batches(rows.sparkSession):
        return rows.select("path", "value").mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors, and fixes what a repeated task could change."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
