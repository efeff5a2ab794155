"""Writers of hierarchies, samples, training files, predictions, results and the edit history."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import image_paths, strip_image_tokens, strip_memory
from ..functions.vocab import CAMERAS, TAKE_SPLITS
from ..operators.ordered import rank_all
from .files import write_files
from .snapshots import Snapshots

#: Splits by take. Recordings in none of them go to train, or to custom when chosen by hand.
SPLITS = ("train", "val", "test")


def hierarchy_documents(l0: DataFrame, l1: DataFrame, l2: DataFrame, metadata: DataFrame | None = None, analysis: DataFrame | None = None) -> DataFrame:
    """(take, value): one JSON document per take, from tables with take, role and ord.

    metadata: take, metadata (a struct); analysis: take, debounce_analysis (a struct). A take's document is one row by the
    format's nature; rows are packed per role first.
    """

    def packed(t: DataFrame, name: str) -> DataFrame:
        item = F.struct("ord", *(c for c in t.columns if c not in ("take", "role", "ord")))
        return t.groupBy("take", "role").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("ord")).alias(name))

    roles = packed(l0, "level0_segments").join(packed(l1, "level1_segments"), ["take", "role"], "left").join(packed(l2, "level2_segments"), ["take", "role"], "left")
    # a level that could not be grouped is empty
    for c in ("level1_segments", "level2_segments"):
        roles = roles.withColumn(c, F.coalesce(c, F.array().cast(roles.schema[c].dataType)))
    n = lambda c: F.size(c)
    body = F.struct("level0_segments", n("level0_segments").alias("num_segments"), "level1_segments", n("level1_segments").alias("num_level1_segments"), "level2_segments", n("level2_segments").alias("num_level2_segments"))
    entry = F.struct("role", body.alias("body"))
    docs = roles.groupBy("take").agg(F.map_from_entries(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["role"] < b["role"], -1).otherwise(1))).alias("roles"))
    for extra in (metadata, analysis):
        docs = docs if extra is None else docs.join(extra, "take", "left")
    return docs.select("take", F.to_json(F.struct(*(c for c in docs.columns if c != "take")), {"pretty": "true"}).alias("value"))


def write_documents(docs: DataFrame, path: str, suffix: str = "_hierarchy.json") -> int:
    """<path>/<take><suffix> for each document; returns how many there are."""
    return write_files(docs.select(F.concat("take", F.lit(suffix)).alias("path"), "value"), path)


def commit_documents(docs: DataFrame, root: str, suffix: str = "_hierarchy.json", entry: dict | None = None) -> str:
    """The documents as a new version of the set below `root`, all at once; returns the folder with <take><suffix>."""
    store = Snapshots(docs.sparkSession, root)
    return store.folder(store.replace_documents(docs.select(F.concat("take", F.lit(suffix)).alias("path"), "value"), entry))


def with_split(samples: DataFrame, splits: dict[str, str], default: str = "train") -> DataFrame:
    """Samples with the split of their take (a table in the code, a few rows)."""
    known = F.create_map(*(F.lit(x) for pair in splits.items() for x in pair)) if splits else F.create_map().cast("map<string,string>")
    return samples.withColumn("split", F.coalesce(known[F.col("take")], F.lit(default)))


def take_splits(spark: SparkSession, splits: dict[str, tuple[str, ...]] = TAKE_SPLITS) -> DataFrame:
    """(take, split, ord): the recordings of all splits, one list after the other."""
    out = None
    for name, takes in splits.items():
        part = spark.createDataFrame([(t, name) for t in takes], "take string, split string")
        out = part if out is None else out.unionByName(part)
    place = {t: i for i, t in enumerate(t for takes in splits.values() for t in takes)}
    return out.withColumn("ord", F.create_map(*(F.lit(x) for pair in place.items() for x in pair))[F.col("take")])


def head_sample(samples: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The first n samples for a dry run, with a row per split they are in: the first three quarters of n train, what is left
    is for validation (the first sample if nothing is), the first quarter is for testing. Views are those of four cameras.
    """
    number = F.coalesce(F.coalesce(F.col("tp_id"), F.substring_index("id", "/", -1)).try_cast("long"), F.lit(0))
    head = samples.orderBy(order).limit(n).withColumn("image", image_paths(number, tuple(CAMERAS.values())))
    head = head.withColumn("_n", F.row_number().over(Window.orderBy(order)) - 1).withColumn("_all", F.count("*").over(Window.partitionBy()))  # n rows
    low, high = max(1, n // 4), max(1, n * 3 // 4)
    val = (F.col("_n") >= high) | ((F.col("_all") <= high) & (F.col("_n") == 0))
    chosen = F.array_compact(F.array(F.when(F.col("_n") < high, "train"), F.when(val, "val"), F.when(F.col("_n") < low, "test")))
    return head.withColumn("split", F.explode(chosen)).drop("_n", "_all")


def keep_existing_images(samples: DataFrame, files: DataFrame, image: str = "image", skip: bool = True) -> DataFrame:
    """Samples with those of their images alone that are in `files` (path), in order. A sample left without any goes, or
    stays with none where not `skip`."""
    found = samples.select("id", F.posexplode(image).alias("_i", "path")).join(files.select("path").distinct(), "path", "left_semi")
    lists = found.groupBy("id").agg(F.transform(F.array_sort(F.collect_set(F.struct("_i", "path"))), lambda x: x["path"]).alias("_kept"))
    kept = samples.join(lists, "id", "inner" if skip else "left")
    return kept.withColumn(image, F.coalesce("_kept", F.array().cast("array<string>"))).select(*samples.columns)


def write_splits(samples: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").partitionBy("split").json(path)


def with_existing_images(samples: DataFrame, files: DataFrame, image: str = "image", empty_ok: bool = False) -> DataFrame:
    """Samples all of whose images are in `files` (path). No image at all counts as missing unless `empty_ok`."""
    wanted = samples.select("id", F.explode(image).alias("path")).join(files.select("path").distinct(), "path", "left_anti").select("id").distinct()
    kept = samples.join(wanted, "id", "left_anti")
    return kept if empty_ok else kept.where(F.size(image) > 0)


def llava(samples: DataFrame, memory: bool) -> DataFrame:
    """id, image, conversations; the memory block is taken out of questions unless kept."""
    turn = lambda c: F.struct(c["from"].alias("from"), (c["value"] if memory else strip_memory(c["value"])).alias("value"))
    return samples.select("id", "image", F.transform("conversations", turn).alias("conversations"))


def sharegpt(samples: DataFrame, memory: bool) -> DataFrame:
    """id, images, pc, audio, messages: one image token per image, the last question and the last answer."""
    last = lambda who: F.element_at(F.filter("conversations", lambda c: c["from"] == who), -1)["value"]
    ask = strip_image_tokens(last("human") if memory else strip_memory(last("human")))
    content = F.concat(F.repeat(F.lit("<image>"), F.size("image")), ask)
    item = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return samples.select("id", F.col("image").alias("images"), F.lit("").alias("pc"), F.lit("").alias("audio"), F.array(item("user", content), item("assistant", last("gpt"))).alias("messages"))


def write_pair(samples: DataFrame, path: str, convert=llava) -> None:
    """<path>/no_memory and <path>/with_memory over the same rows; raises if there are none."""
    if samples.isEmpty():
        raise ValueError("no sample is left to write")
    for name, memory in (("no_memory", False), ("with_memory", True)):
        convert(samples, memory).write.mode("overwrite").json(f"{path}/{name}")


def write_predictions(rows: DataFrame, path: str, group: list[str]) -> None:
    """Each group in a folder of its own, replaced whole: a run that is repeated leaves one copy."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*group).json(path)


def canonical(predictions: DataFrame, samples: DataFrame) -> DataFrame:
    """The last prediction per id, in sample order, those without a sample last. predictions: id, ord; samples: id, ord."""
    one = predictions.groupBy("id").agg(F.max_by(F.struct(*predictions.columns), "ord").alias("_p")).select("_p.*")
    place = samples.groupBy("id").agg(F.min("ord").alias("_place"))
    return one.join(place, "id", "left").orderBy(F.col("_place").asc_nulls_last(), "ord").drop("_place")


def in_sample_order(predictions: DataFrame, samples: DataFrame) -> DataFrame:
    """The rows of `canonical` with their place in that order as `position`, from 1; no task sees them all."""
    one = predictions.groupBy("id").agg(F.max_by(F.struct(*predictions.columns), "ord").alias("_p")).select("_p.*")
    place = samples.groupBy("id").agg(F.min("ord").alias("_place"))
    met = one.join(place, "id", "left").withColumn("_late", F.col("_place").isNull())
    return rank_all(met, ["_late", "_place", "ord", "id"], "position").withColumn("position", F.col("position") + 1).drop("_place", "_late")


def write_baselines(baselines: dict[str, DataFrame], path: str) -> None:
    """<path>/<name>: the rows of each baseline as JSON lines."""
    for name, rows in baselines.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def results_document(results: DataFrame, levels: tuple[str, ...] = ("l0", "l1", "l2")) -> DataFrame:
    """(value): the results as one nested JSON document: matched, total_predictions, an object per level, l2_exact_match.

    results: level, metric, value; a row per metric. Without a match the document holds `matched` alone.
    """
    one = lambda level, metric: F.max(F.when((F.col("level") == level) & (F.col("metric") == metric), F.col("value")))
    pair = F.struct("metric", "value")
    inner = lambda x: F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("level") == x) & (F.col("metric") != "exact_match"), pair))))
    flat = results.agg(one("all", "matched").cast("long").alias("matched"), one("all", "total_predictions").cast("long").alias("total_predictions"), *(inner(x).alias(x) for x in levels), one("l2", "exact_match").alias("l2_exact_match"))
    for x in levels:
        flat = flat.withColumn(x, F.when(F.size(x) > 0, F.col(x)))
    return flat.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))


def write_results(results: DataFrame, root: str, name: str = "results.json") -> int:
    return write_files(results_document(results).select(F.lit(name).alias("path"), "value"), root)


def flatten_results(results: DataFrame) -> DataFrame:
    """(name, value) with names `level/metric`."""
    return results.select(F.concat_ws("/", "level", "metric").alias("name"), "value")


def append_history(spark: SparkSession, path: str, entries: list[str]) -> None:
    """Add free-form JSON entries; one without a timestamp gets the time of writing."""
    rows = spark.createDataFrame([(e,) for e in entries], "entry string")
    stamped = rows.select("entry", F.coalesce(F.get_json_object("entry", "$.timestamp"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"))
    stamped.write.mode("append").parquet(path)


def overwrite_safely(df: DataFrame, path: str) -> None:
    """Write beside the target, then swap: a reader sees the old rows or the new, and the old may be read by `df` itself."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    temporary, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    df.write.parquet(temporary)
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.rename(target, jvm.org.apache.hadoop.fs.Path(old))
    fs.rename(jvm.org.apache.hadoop.fs.Path(temporary), target)
    fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)
