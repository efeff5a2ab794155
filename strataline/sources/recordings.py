"""Readers of recording folders, transcripts, samples, predictions and hierarchy documents. Schemas are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_take, srt_seconds, strip, take_number, take_suffix
from ..operators.timeline import screen_choice
from . import labels

FRAME = "original_timestamp int, azure string, simstation string, trackercam string, tracker string"
TRANSCRIPT = "array<struct<start:double,end:double,text:string>>"
L0 = f"struct<segment_id:string,role:string,role_human:string,level:int,tp_start:string,tp_end:string,duration_frames:int,active_predicates:array<array<string>>,time_start:int,time_end:int,duration_s:int,description:string,transcript:{TRANSCRIPT}>"
STEP = f"segment_id:string,role:string,role_human:string,level:int,time_start:int,time_end:int,duration_s:int,summary:string,audio_summary:string,transcript:{TRANSCRIPT}"
HIERARCHY = f"struct<roles:map<string,struct<level0_segments:array<{L0}>,level1_segments:array<struct<segment_ids:array<string>,{STEP}>>,level2_segments:array<struct<child_ids:array<string>,{STEP}>>>>>"
SAMPLE = "id string, image array<string>, take string, role string, role_human string, l2_segment_id string, tp_id string, conversations array<struct<from:string,value:string>>, gt_l0 string, gt_l1 string, gt_l2 string, gt_l0_seg_id string, gt_l1_seg_id string, gt_l2_seg_id string"
PREDICTION = "id string, take string, role string, role_human string, tp_id string, l2_segment_id string, pred_l0 string, pred_l1 string, pred_l2 string, raw_output string, gt_l0 string, gt_l1 string, gt_l2 string"


def _whole(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, value): whole text files. A pattern that matches nothing is an empty table."""
    try:
        return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "path string, value string")
        raise


def _part(path: Column, back: int) -> Column:
    """Part of a path, counted from its end (1: file name)."""
    return F.element_at(F.split(F.url_decode(path), "/"), -back)


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def frame_map(spark: SparkSession, root: str) -> DataFrame:
    """(take, tp_id, frame columns): the time point is the place in the array, in six digits; the entry's own key is ignored."""
    docs = _whole(spark, f"{root}/*/timestamp_to_pcd_and_frames_list.json")
    entries = docs.select(_part(F.col("path"), 2).alias("take"), F.posexplode(F.from_json("value", "array<array<string>>")).alias("pos", "entry"))
    frame = F.from_json(F.element_at("entry", 2), FRAME)
    return entries.select("take", F.lpad(F.col("pos").cast("string"), 6, "0").alias("tp_id"), frame.alias("f")).select("take", "tp_id", "f.*")


def relation_labels(spark: SparkSession, root: str, frames: DataFrame) -> DataFrame:
    """(take, tp_id, triplets array<struct<subj,pred,obj>>): unmapped time points are empty, files that do not parse are left out.

    frames: the frame map of `root`. Files of unmapped time points are not opened, where Python reaches the store.
    """
    if labels.reachable(root):
        named = labels.label_files(spark, root).select("take", "tp_id", "value")
    else:
        docs = _whole(spark, f"{root}/*/relation_labels/*.json")
        named = docs.select(_part(F.col("path"), 3).alias("take"), _stem(_part(F.col("path"), 1)).alias("tp_id"), "value")
    joined = named.join(frames.select("take", "tp_id", F.lit(True).alias("_mapped")), ["take", "tp_id"], "left")
    parsed = F.when(F.col("_mapped"), F.from_json("value", "struct<rel_annotations:array<array<string>>>")["rel_annotations"]).otherwise(F.array().cast("array<array<string>>"))
    triplets = F.transform(parsed, lambda t: F.struct(t[0].alias("subj"), t[1].alias("pred"), t[2].alias("obj")))
    return joined.select("take", "tp_id", triplets.alias("triplets")).where(F.col("triplets").isNotNull())


def robot_phases(spark: SparkSession, root: str, takes: DataFrame) -> DataFrame:
    """(take, tp_id, phase): a take's own file, else all files of its split sessions; the later file wins."""
    docs = _whole(spark, f"{root}/take_timestamp_to_robot_phase/*.json").select(_stem(_part(F.col("path"), 1)).alias("file"), "value")
    rows = for_take(takes, docs.select("file")).join(docs, "file").select("take", "file", F.explode(F.from_json("value", "map<string,string>")).alias("tp_id", "phase"))
    return rows.groupBy("take", "tp_id").agg(F.max_by("phase", "file").alias("phase"))


def for_take(takes: DataFrame, files: DataFrame) -> DataFrame:
    """(take, file): the file named like the take, else those named `<number>*_<suffix>`. Names only, joined by the first
    three characters (a take's number has three digits at least) and the suffix; contents join later, by name."""
    number, suffix = take_number(F.col("take")), take_suffix(F.col("take"))
    left = takes.select("take").distinct().withColumn("_a", F.substring("take", 1, 3)).withColumn("_z", suffix)
    right = files.select("file").distinct().withColumn("_a", F.substring("file", 1, 3)).withColumn("_z", take_suffix(F.col("file")))
    fits = (F.col("file") == F.col("take")) | (F.col("file").startswith(number) & F.col("file").endswith(F.concat(F.lit("_"), suffix)))
    pairs = left.join(right, ["_a", "_z"]).where(fits).select("take", "file")
    own = F.max(F.col("file") == F.col("take")).over(Window.partitionBy("take"))
    return pairs.withColumn("_own", own).where(~F.col("_own") | (F.col("file") == F.col("take"))).drop("_own")


def screen_summaries(spark: SparkSession, root: str, frames: DataFrame) -> DataFrame:
    """(take, tp_id, phase, step) by way of the simstation frame; the surest reading of each kind."""
    docs = _whole(spark, f"{root}/screen_summaries/*/*.json")
    named = docs.select(_part(F.col("path"), 2).alias("file"), _stem(_part(F.col("path"), 1)).alias("simstation"), "value")
    dirs = for_take(frames.select("take"), named.select("file").distinct())
    reading = F.from_json("value", "map<string,struct<type:string,certainty:string>>")
    rows = dirs.join(named, "file").join(frames.select("take", "tp_id", "simstation"), ["take", "simstation"])
    rows = rows.select("take", "tp_id", "file", F.posexplode(F.map_entries(reading)).alias("pos", "e")).select("take", "tp_id", "file", "pos", F.col("e.key").alias("name"), "e.value.type", "e.value.certainty")
    return screen_choice(rows, ["take", "tp_id"], ["file", "pos"]).where(F.col("phase").isNotNull() | F.col("step").isNotNull())


def parse_srt(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep, ord, start_s, end_s, text) of SRT texts; blocks under three lines or without a time line are dropped."""
    blocks = df.select(*keep, F.posexplode(F.split(strip(F.col(text)), r"\n\s*\n")).alias("ord", "block"))
    lines = F.split(strip(F.col("block")), "\n")
    line = F.element_at(lines, 2)
    clock = r"\d{2}:\d{2}:\d{2}[,.]\d{3}"
    found = blocks.where((F.size(lines) >= 3) & line.rlike(rf"^{clock}\s*-->\s*{clock}"))
    at = lambda k: srt_seconds(F.regexp_extract(line, rf"^({clock})\s*-->\s*({clock})", k))
    return found.select(*keep, "ord", at(1).alias("start_s"), at(2).alias("end_s"), strip(F.array_join(F.slice(lines, 3, 1 << 30), " ")).alias("text"))


def transcripts(spark: SparkSession, root: str) -> DataFrame:
    """(take, ord, start_s, end_s, text): a take's file below `root`, else the one beside it."""
    read = lambda top, rank: _whole(spark, f"{top}/take_transcripts/*.srt").select(_stem(_part(F.col("path"), 1)).alias("take"), F.lit(rank).alias("rank"), "value")
    docs = read(root, 0).unionByName(read(root.rstrip("/").rpartition("/")[0], 1))
    return parse_srt(docs.groupBy("take").agg(F.min_by("value", "rank").alias("value")), "value", ["take"])


def takes(spark: SparkSession, root: str, min_labels: int = 10) -> DataFrame:
    """Takes that can be processed: named like one, with a frame map and enough label files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{root}/*/relation_labels/").select("path")
    counts = files.select(_part(F.col("path"), 3).alias("take"), _part(F.col("path"), 1).alias("name")).where(F.col("name").rlike("^[0-9]")).groupBy("take").count().where(F.col("count") >= min_labels)
    maps = _whole(spark, f"{root}/*/timestamp_to_pcd_and_frames_list.json").select(_part(F.col("path"), 2).alias("take"))
    return counts.where(is_take(F.col("take"))).join(maps, "take", "left_semi").select("take")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample lines; a line that is no JSON is an error."""
    return spark.read.schema(SAMPLE).option("mode", "FAILFAST").json(path)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction lines so far: none if there is no file, broken lines skipped, the last line of an id counts."""
    try:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_n"))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], PREDICTION)
        raise
    rows = lines.select("_f", "_b", "_n", F.from_json("value", PREDICTION, {"mode": "PERMISSIVE"}).alias("p")).where(F.coalesce(F.col("p.id"), F.lit("")) != "")
    return rows.groupBy("p.id").agg(F.max_by("p", F.struct("_f", "_b", "_n")).alias("p")).select("p.*")


def hierarchies(spark: SparkSession, pattern: str) -> dict[str, DataFrame]:
    """Tables l0, l1, l2 of hierarchy documents, with take (file name up to _hierarchy), role key and place (ord)."""
    docs = _whole(spark, pattern).select(F.regexp_replace(_stem(_part(F.col("path"), 1)), r"_hierarchy.*$", "").alias("take"), F.from_json("value", HIERARCHY).alias("h"))
    roles = docs.select("take", F.explode("h.roles").alias("role_key", "r"))
    out = {}
    for level in range(3):
        rows = roles.select("take", "role_key", F.posexplode(f"r.level{level}_segments").alias("ord", "s")).select("take", "role_key", "ord", "s.*")
        out[f"l{level}"] = rows.withColumn("role_human", F.coalesce("role_human", "role_key"))
    return out


def latest_checkpoint(paths: DataFrame) -> DataFrame:
    """The path of the highest number in `checkpoint-<n>`; others count as -1."""
    number = F.coalesce(F.regexp_extract("path", r"checkpoint-(\d+)/?$", 1).try_cast("int"), F.lit(-1))
    return paths.agg(F.max_by("path", number).alias("path"))


def model_path(listing: DataFrame, root: str) -> DataFrame:
    """(path): `root` if an adapter file stands in it, else its latest checkpoint folder, else `root`.

    listing: path of every file and folder below `root`.
    """
    root = root.rstrip("/")
    top = listing.where(F.col("path").isin(f"{root}/adapter_config.json", f"{root}/adapter_model.bin")).agg(F.count("*").alias("n"))
    inner = listing.where(F.col("path").startswith(f"{root}/checkpoint-")).select(F.concat(F.lit(f"{root}/"), F.substring_index(F.substring("path", len(root) + 2, 1 << 20), "/", 1)).alias("path"))
    best = latest_checkpoint(inner)  # one row each
    return best.join(F.broadcast(top)).select(F.when(F.col("n") > 0, F.lit(root)).otherwise(F.coalesce("path", F.lit(root))).alias("path"))


def simstation_map(frames: DataFrame) -> DataFrame:
    """(take, original_timestamp, simstation): the screen shown at a second; of several time points the last."""
    known = frames.where(F.col("original_timestamp").isNotNull() & F.col("simstation").isNotNull())
    return known.groupBy("take", "original_timestamp").agg(F.max_by("simstation", "tp_id").alias("simstation"))
