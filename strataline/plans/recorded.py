"""Queries over recordings: the events table is written out as recording folders, transcripts, samples, predictions and
hierarchy documents, and the library's readers and writers run over those. Beside each query stands its SQL over the events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..functions import vocab as V
from ..operators import baselines as L
from ..operators import grouping as G
from ..operators import inference as P
from ..operators import intervals as J
from ..operators import timeline as S
from ..sources import files
from ..sources import recordings as R
from ..sources import sinks as K
from ..sources import snapshots as N
from . import hierarchy as H
from . import training as B
from . import viewer as W
from .samples import _FRAMES, _MEMORY
from .timelines import E, debounce_sql, events

QUERIES: dict = {}
SQL: dict[str, str] = {}
_ROOTS: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# A user is in one of seven recordings, six hours are a time point; the type says who does what.
_SUBJECTS = ("head_surgeon", "nurse", "mps", "patient")
_OBJECTS = ("drill", "patient", "saw")
_PREDICATES = {"click": "Touching", "view": "CloseTo", "purchase": "Holding", "error": "Sawing", "signup": "Pondering"}
_pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
_list = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + "]"

_X = f"""{E}, x AS (SELECT *, printf('9%02d_PKA', user_id % 7) AS take, CAST(hour // 6 AS BIGINT) AS b,
  {_list(_SUBJECTS)}[user_id % 4 + 1] AS subj, CASE event_type {" ".join(f"WHEN '{a}' THEN '{p}'" for a, p in _PREDICATES.items())} END AS pred, {_list(_OBJECTS)}[event_id % 3 + 1] AS obj FROM e),
fm AS (SELECT take, b, printf('%06d', row_number() OVER (PARTITION BY take ORDER BY b) - 1) AS tp_id FROM (SELECT DISTINCT take, b FROM x))"""


def recorded(spark, d):
    """Events with take, block of six hours (b), time point, and the triplet they stand for."""
    from pyspark.sql import Window

    ev = events(spark, d)
    rows = ev.select("event_id", "user_id", "value", "event_type", "k", "sec", F.format_string("9%02d_PKA", F.col("user_id") % 7).alias("take"), F.floor(F.col("hour") / 6).alias("b"), _pick(_SUBJECTS, F.col("user_id")).alias("subj"), V.lookup(F.col("event_type"), _PREDICATES).alias("pred"), _pick(_OBJECTS, F.col("event_id")).alias("obj"))
    # the time points of a recording are few, its events are not: places are found among those
    points = rows.select("take", "b").distinct().withColumn("tp_id", F.format_string("%06d", F.row_number().over(Window.partitionBy("take").orderBy("b")) - 1))
    return rows.join(points, ["take", "b"])


def tree(spark, d) -> str:
    """The recording folders of a table folder, written once per application."""
    key = (spark.sparkContext.applicationId, d)
    if key in _ROOTS:
        return _ROOTS[key]
    top = files.scratch(spark, "recordings")
    root = f"{top}/processed"
    x = recorded(spark, d).cache()
    lists = lambda t, keys, item, order, out: t.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, item.alias("v")))), lambda s: s["v"]).alias(out))
    number = F.substring("take", 1, 3)
    odd = F.substring("take", 3, 1).cast("int") % 2 == 1
    points = x.select("take", "b", "tp_id").distinct()
    # frame maps
    frame = F.to_json(F.struct((F.col("b") * 10).cast("int").alias("original_timestamp"), F.format_string("%06d", "b").alias("azure"), F.format_string("%06d", F.floor(F.col("b") / 2)).alias("simstation"), F.lit(1).alias("more")))
    entry = F.concat(F.lit('["ignored", '), frame, F.lit("]"))
    maps = lists(points, ["take"], entry, ["b"], "v").select(F.concat("take", F.lit("/timestamp_to_pcd_and_frames_list.json")).alias("path"), F.concat(F.lit("["), F.array_join("v", ", "), F.lit("]")).alias("value"))
    # labels: one file a time point; in 903 the file of 000005 is broken, and each take has one that no time point maps to
    labels = lists(x, ["take", "tp_id"], F.array("subj", "pred", "obj"), ["event_id"], "rel_annotations")
    body = F.when((F.col("take") == "903_PKA") & (F.col("tp_id") == "000005"), "{broken").otherwise(F.to_json(F.struct("rel_annotations")))
    label_files = labels.select(F.concat("take", F.lit("/relation_labels/"), "tp_id", F.lit(".json")).alias("path"), body.alias("value"))
    stray = x.select("take").distinct().select(F.concat("take", F.lit("/relation_labels/999999.json")).alias("path"), F.lit("{broken").alias("value"))
    # phases: even takes have a file of their own (and a session's that does not count), odd ones two sessions
    phase = lambda rows, name, tag: lists(rows, ["take"], F.concat(F.lit('"'), "tp_id", F.lit(f'": "{tag}'), F.col("b") % 5, F.lit('"')), ["b"], "v").select(F.concat(F.lit("take_timestamp_to_robot_phase/"), name, F.lit(".json")).alias("path"), F.concat(F.lit("{"), F.array_join("v", ", "), F.lit("}")).alias("value"))
    phases = phase(points.where(~odd), F.col("take"), "P").unionByName(phase(points, F.concat(number, F.lit("_1_PKA")), "A")).unionByName(phase(points.where(odd & (F.col("b") % 2 == 0)), F.concat(number, F.lit("_2_PKA")), "B"))
    # screens: readings by event, a file per screen
    kind = F.when(F.col("event_type") == "click", "phase").when(F.col("event_type") == "purchase", "current_step").otherwise("other")
    reading = F.concat(F.lit('"n'), "event_id", F.lit('": '), F.to_json(F.struct(kind.alias("type"), F.when(F.col("k") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("certainty"))))
    screens = lists(x.withColumn("s", F.floor(F.col("b") / 2)), ["take", "s"], reading, ["event_id"], "v").select(F.concat(F.lit("screen_summaries/"), "take", F.lit("/"), F.format_string("%06d", "s"), F.lit(".json")).alias("path"), F.concat(F.lit("{"), F.array_join("v", ", "), F.lit("}")).alias("value"))
    # transcripts: below the root for even takes, beside it for odd ones; 900 has both
    clock = lambda s: F.format_string("%02d:%02d:%02d,000", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    cue = F.concat(F.lit("1\n"), clock(F.col("b") * 10 + 3), F.lit(" --> "), clock(F.col("b") * 10 + 12), F.lit("\nsays\n"), F.col("b"))
    srt = lambda rows, where, more: lists(rows, ["take"], F.concat(cue, F.lit(more)), ["b"], "v").select(F.concat(F.lit(where), "take", F.lit(".srt")).alias("path"), F.array_join("v", "\n\n").alias("value"))
    said = srt(points.where(~odd), "processed/take_transcripts/", "").unionByName(srt(points.where(odd | (F.col("take") == "900_PKA")), "take_transcripts/", " beside"))
    stray_map = spark.createDataFrame([("not_a_take/timestamp_to_pcd_and_frames_list.json", "[]")], "path string, value string")
    inner = maps.unionByName(label_files).unionByName(stray).unionByName(phases).unionByName(screens).unionByName(stray_map)
    files.write_files(inner.select(F.concat(F.lit("processed/"), "path").alias("path"), "value").unionByName(said), top)
    x.unpersist()
    _ROOTS[key] = root
    return root


# ---------------------------------------------------------------- readers


@query(f"""WITH {_X} SELECT take, tp_id, b * 10 AS original_timestamp, printf('%06d', b) AS azure, printf('%06d', b // 2) AS simstation FROM fm""")
def frame_map_reader(spark, d):
    return R.frame_map(spark, tree(spark, d)).select("take", "tp_id", F.col("original_timestamp").cast("long").alias("original_timestamp"), "azure", "simstation")


_LABELS = "(SELECT x.take, tp_id, event_id, subj, pred, obj FROM x JOIN fm ON fm.take = x.take AND fm.b = x.b WHERE NOT (x.take = '903_PKA' AND tp_id = '000005'))"


@query(f"""WITH {_X} SELECT take, tp_id, string_agg(subj || ':' || pred || ':' || obj, ';' ORDER BY event_id) AS triplets FROM {_LABELS} GROUP BY take, tp_id
UNION ALL SELECT DISTINCT take, '999999', '' FROM fm""")
def relation_labels_reader(spark, d):
    root = tree(spark, d)
    rows = R.relation_labels(spark, root, R.frame_map(spark, root))
    return rows.select("take", "tp_id", F.array_join(F.transform("triplets", lambda t: F.concat_ws(":", t["subj"], t["pred"], t["obj"])), ";").alias("triplets"))


@query(f"""WITH {_X} SELECT take, tp_id, CASE WHEN take[3]::INT % 2 = 0 THEN 'P' WHEN b % 2 = 0 THEN 'B' ELSE 'A' END || (b % 5) AS phase FROM fm""")
def robot_phases_reader(spark, d):
    root = tree(spark, d)
    return R.robot_phases(spark, root, R.takes(spark, root)).select("take", "tp_id", "phase")


_SCREENS = """sc AS (SELECT take, b // 2 AS s, arg_min(name, (-c, event_id)) FILTER (WHERE event_type = 'click') AS phase, arg_min(name, (-c, event_id)) FILTER (WHERE event_type = 'purchase') AS step
  FROM (SELECT take, b, event_id, event_type, 'n' || event_id AS name, CASE WHEN k % 7 = 0 THEN 0.0 ELSE value END AS c FROM x) WHERE c > -1 GROUP BY take, b // 2)"""


@query(f"""WITH {_X}, {_SCREENS} SELECT fm.take, tp_id, phase, step FROM fm JOIN sc ON sc.take = fm.take AND sc.s = fm.b // 2 WHERE phase IS NOT NULL OR step IS NOT NULL""")
def screen_summaries_reader(spark, d):
    root = tree(spark, d)
    frames = R.frame_map(spark, root)
    return R.screen_summaries(spark, root, frames.where(T.is_take(F.col("take")))).select("take", "tp_id", "phase", "step")


@query(f"""WITH {_X} SELECT take, take[1:3] AS number, 'PKA' AS suffix FROM fm GROUP BY take HAVING count(*) >= 10""")
def processable_takes(spark, d):
    return R.takes(spark, tree(spark, d), 11).select("take", T.take_number(F.col("take")).alias("number"), T.take_suffix(F.col("take")).alias("suffix"))


@query(f"""WITH {_X} SELECT take, CAST(row_number() OVER (PARTITION BY take ORDER BY b) - 1 AS BIGINT) AS ord, b * 10 + 3 AS start_s, b * 10 + 12 AS end_s, 'says ' || b || CASE WHEN take[3]::INT % 2 = 1 THEN ' beside' ELSE '' END AS text FROM fm""")
def transcripts_reader(spark, d):
    return R.transcripts(spark, tree(spark, d)).select("take", F.col("ord").cast("long").alias("ord"), F.col("start_s").cast("long").alias("start_s"), F.col("end_s").cast("long").alias("end_s"), "text")


@query(f"""WITH {_X} SELECT take, tp_id, '{{"original_timestamp":' || (b * 10) || ',"camera01":"' || printf('%06d', b) || '","camera02":"' || printf('%06d', b // 2) || '"}}' AS info FROM fm""")
def frame_info_records(spark, d):
    return H.frame_info(R.frame_map(spark, tree(spark, d)))


@query(f"""WITH {_X} SELECT take, b * 10 AS original_timestamp, printf('%06d', b // 2) AS simstation FROM fm""")
def simstation_by_second(spark, d):
    frames = R.frame_map(spark, tree(spark, d))
    twice = frames.unionByName(frames.withColumn("tp_id", F.lit("")).withColumn("simstation", F.lit("early")))
    return R.simstation_map(twice).select("take", F.col("original_timestamp").cast("long").alias("original_timestamp"), "simstation")


@query(f"""WITH {_X} SELECT 'm/checkpoint-' || max(event_id) AS path, 'm' AS adapted FROM e""")
def checkpoint_lookup(spark, d):
    paths = events(spark, d).select(F.concat(F.lit("m/checkpoint-"), "event_id", F.lit("/weights.bin")).alias("path"))
    adapted = R.model_path(paths.unionByName(spark.createDataFrame([("m/adapter_config.json",)], "path string")), "m/")
    return R.model_path(paths.unionByName(spark.createDataFrame([("m/checkpoint-last/x",)], "path string")), "m").join(F.broadcast(adapted.withColumnRenamed("path", "adapted")))


# ---------------------------------------------------------------- ranges, files and samples


@query(f"""WITH {_X}, l AS (SELECT DISTINCT take, tp_id FROM {_LABELS} UNION SELECT DISTINCT take, '999999' FROM fm),
h AS (SELECT *, row_number() OVER (PARTITION BY take ORDER BY tp_id) AS n FROM l WHERE tp_id >= '000003')
SELECT take, tp_id, tp_id >= '000002' AND tp_id <= '000009' AS in_range, coalesce((SELECT max(n) <= 5 FROM h WHERE h.take = l.take AND h.tp_id = l.tp_id), false) AS in_head FROM l""")
def time_point_ranges(spark, d):
    root = tree(spark, d)
    labels = R.relation_labels(spark, root, R.frame_map(spark, root)).select("take", "tp_id")
    marked = lambda t, name: t.withColumn(name, F.lit(True))
    some = marked(H.tp_range(labels, "000002", "000009"), "in_range").join(marked(H.entries(labels, "000003", 5), "in_head"), ["take", "tp_id"], "full")
    no = F.lit(False)
    return H.tp_range(labels, "", None).join(some, ["take", "tp_id"], "left").select("take", "tp_id", F.coalesce("in_range", no).alias("in_range"), F.coalesce("in_head", no).alias("in_head"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '001_PKA_hierarchy_v' || event_id || '.json' WHEN event_id % 3 = 1 THEN '../x' || event_id || '_hierarchy.json' ELSE event_type || '.json' END AS file,
  event_id % 3 = 0 AS safe, CASE WHEN event_id % 3 = 0 THEN '001_PKA' END AS take FROM events""")
def safe_file_names(spark, d):
    m = F.col("event_id") % 3
    file = F.when(m == 0, F.concat(F.lit("001_PKA_hierarchy_v"), "event_id", F.lit(".json"))).when(m == 1, F.concat(F.lit("../x"), "event_id", F.lit("_hierarchy.json"))).otherwise(F.concat("event_type", F.lit(".json")))
    rows = events(spark, d).select("event_id", file.alias("file"))
    return rows.select("event_id", "file", T.is_safe_name(F.col("file")).alias("safe"), T.take_of_file(F.col("file")).alias("take"))


@query("""WITH r AS (SELECT unnest(['001_PKA', '002_PKA', '003_TKA', '004_PKA', '005_TKA', '006_PKA', '007_TKA', '008_PKA', '009_TKA', '010_PKA', '011_TKA', '013_PKA', '014_PKA', '033_PKA', '035_PKA', '036_PKA', '037_TKA', '038_TKA']) AS take,
  unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17]::BIGINT[]) AS ord, unnest(['train', 'train', 'train', 'train', 'train', 'train', 'train', 'train', 'train', 'val', 'val', 'val', 'test', 'test', 'test', 'test', 'test', 'test']) AS split)
SELECT take, ord, split, count(event_id) AS n FROM r LEFT JOIN events ON user_id % 20 = ord GROUP BY ALL""")
def recordings_of_all_splits(spark, d):
    """Every recording of the splits with the number of its events; events of two takes are in none."""
    taken = events(spark, d).groupBy((F.col("user_id") % 20).alias("ord")).agg(F.count("*").alias("n"))
    return K.take_splits(spark).join(taken, "ord", "left").select("take", F.col("ord").cast("long").alias("ord"), "split", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


# A sample per event: the truth of a frame, its views and its conversation.
_SAMPLE = f"""{E}, s AS (SELECT event_id, 't' || (user_id % 4) AS take, 'r' || (user_id % 3) AS role, 's' || (user_id % 5) AS l2, printf('%06d', event_id) AS tp, event_type AS l0, 'v' || (k % 4) AS l1, 'w' || (k % 2) AS l2_says, k,
  [printf('colorimage/a-%06d.jpg', k), printf('colorimage/b-%06d.jpg', k % 9)] AS image FROM e)"""


def samples(spark, d):
    ev = events(spark, d)
    k, n = F.col("k"), F.col("event_id")
    image = F.array(F.format_string("colorimage/a-%06d.jpg", k), F.format_string("colorimage/b-%06d.jpg", k % 9))
    take, role, l2 = F.concat(F.lit("t"), F.col("user_id") % 4), F.concat(F.lit("r"), F.col("user_id") % 3), F.concat(F.lit("s"), F.col("user_id") % 5)
    tp = F.format_string("%06d", n)
    block = F.when(k % 2 == 0, F.concat(F.lit("<memory_start>\nLong: L0:"), "event_type", F.lit("\n<memory_end>"))).otherwise("")
    says = {"gt_l0": F.col("event_type"), "gt_l1": F.concat(F.lit("v"), k % 4), "gt_l2": F.concat(F.lit("w"), k % 2)}
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    talk = F.array(turn("human", T.prompt(role, block)), turn("gpt", T.answer(*says.values())))
    return ev.select(n.alias("ord"), F.concat_ws("/", take, role, l2, tp).alias("id"), image.alias("image"), take.alias("take"), role.alias("role"), role.alias("role_human"), l2.alias("l2_segment_id"), tp.alias("tp_id"), talk.alias("conversations"), *(c.alias(a) for a, c in says.items()), l2.alias("gt_l2_seg_id"))


_ASK = "'Role: ' || role || chr(10) || {0} || 'Describe the current activity hierarchy for this role.'"
_BLOCK = "CASE WHEN k % 2 = 0 THEN '<memory_start>' || chr(10) || 'Long: L0:' || l0 || chr(10) || '<memory_end>' || chr(10) ELSE '' END"
_ID = "take || '/' || role || '/' || l2 || '/' || tp"
_ANSWER = "'L0: ' || l0 || ' | L1: ' || l1 || ' | L2: ' || l2_says"


@query(f"""WITH {_SAMPLE} SELECT {_ID} AS id, array_to_string(image, ',') AS image, '<image>' || chr(10) || {_ASK.format(_BLOCK)} AS asked, {_ANSWER} AS answer, l2_says AS gt_l2 FROM s""")
def samples_roundtrip(spark, d):
    at = files.scratch(spark, "samples")
    K.write_splits(K.with_split(samples(spark, d).drop("ord"), {"t0": "train", "t1": "val"}, "custom"), at)
    rows = R.samples(spark, at)
    turn = lambda i: F.col("conversations")[i]["value"]
    return rows.select("id", F.array_join("image", ",").alias("image"), turn(0).alias("asked"), turn(1).alias("answer"), "gt_l2")


@query(f"""WITH {_SAMPLE} SELECT {_ID} AS id, array_to_string(list_transform(image, lambda p: take || '/' || p), ',') AS image, '<image>' || chr(10) || {_ASK.format("''")} AS plain, '<image>' || chr(10) || {_ASK.format(_BLOCK)} AS full_text, {_ANSWER} AS answer FROM s""")
def llava_rows(spark, d):
    rows = samples(spark, d).withColumn("image", T.relative_images(F.col("image"), F.col("take")))
    first = lambda t, name: t.select("id", F.col("conversations")[0]["value"].alias(name), F.array_join("image", ",").alias("image"), F.col("conversations")[1]["value"].alias("answer"))
    return first(K.llava(rows, False), "plain").join(first(K.llava(rows, True), "full_text").select("id", "full_text"), "id")


@query(f"""WITH {_SAMPLE} SELECT {_ID} AS id, len(image) AS n_images, '<image><image>' || {_ASK.format("''")} AS asked, {_ANSWER} AS answer, '' AS pc FROM s""")
def sharegpt_rows(spark, d):
    rows = K.sharegpt(samples(spark, d), False)
    return rows.select("id", F.size("images").cast("long").alias("n_images"), F.col("messages")[0]["content"].alias("asked"), F.col("messages")[1]["content"].alias("answer"), "pc")


@query(f"""WITH {_SAMPLE}, m AS (SELECT unnest([false, true]) AS memory)
SELECT memory, {_ID} AS id, '<image>' || chr(10) || CASE WHEN memory THEN {_ASK.format(_BLOCK)} ELSE {_ASK.format("''")} END AS llava, '<image><image>' || CASE WHEN memory THEN {_ASK.format(_BLOCK)} ELSE {_ASK.format("''")} END AS sharegpt, {_ANSWER} AS answer FROM s, m""")
def training_pairs(spark, d):
    """Both kinds of training files, with memory and without, written and read again."""
    at = files.scratch(spark, "pairs")
    rows = samples(spark, d)
    K.write_pair(rows, f"{at}/llava")
    K.write_pair(rows, f"{at}/sharegpt", K.sharegpt)
    out = None
    for name, memory in (("no_memory", False), ("with_memory", True)):
        a = spark.read.schema("id string, conversations array<struct<from:string,value:string>>").json(f"{at}/llava/{name}").select("id", F.col("conversations")[0]["value"].alias("llava"))
        b = spark.read.schema("id string, messages array<struct<role:string,content:string>>").json(f"{at}/sharegpt/{name}").select("id", F.col("messages")[0]["content"].alias("sharegpt"), F.col("messages")[1]["content"].alias("answer"))
        both = a.join(b, "id").select(F.lit(memory).alias("memory"), "id", "llava", "sharegpt", "answer")
        out = both if out is None else out.unionByName(both)
    return out


_FILES = "f AS (SELECT DISTINCT printf('colorimage/a-%06d.jpg', k) AS path FROM e WHERE k % 3 > 0 UNION SELECT DISTINCT printf('colorimage/b-%06d.jpg', k % 9) FROM e WHERE k % 9 <> 4)"


@query(f"""WITH {_SAMPLE}, {_FILES}, p AS (SELECT {_ID} AS id, unnest([1, 2]) AS i, unnest(image) AS path FROM s)
SELECT id, count(*) = 2 AS whole, string_agg(p.path, ',' ORDER BY i) AS kept FROM p JOIN f ON f.path = p.path GROUP BY id""")
def images_that_exist(spark, d):
    ev = events(spark, d)
    there = ev.where("k % 3 > 0").select(F.format_string("colorimage/a-%06d.jpg", "k").alias("path")).unionByName(ev.where("k % 9 <> 4").select(F.format_string("colorimage/b-%06d.jpg", F.col("k") % 9).alias("path"))).distinct()
    rows = samples(spark, d)
    whole = K.with_existing_images(rows, there).select("id", F.lit(True).alias("whole"))
    return K.keep_existing_images(rows, there).join(whole, "id", "left").select("id", F.coalesce("whole", F.lit(False)).alias("whole"), F.array_join("image", ",").alias("kept"))


@query(f"""WITH {_SAMPLE}, h AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS n FROM s ORDER BY event_id LIMIT 32)
SELECT 'train' AS split, {_ID} AS id, printf('colorimage/camera01_colorimage-%06d.jpg', event_id) AS view FROM h WHERE n < 24
UNION ALL SELECT 'val', {_ID}, printf('colorimage/camera01_colorimage-%06d.jpg', event_id) FROM h WHERE n >= 24 UNION ALL SELECT 'test', {_ID}, printf('colorimage/camera01_colorimage-%06d.jpg', event_id) FROM h WHERE n < 8""")
def dry_run_sample(spark, d):
    return K.head_sample(samples(spark, d), 32).select("split", "id", F.col("image")[0].alias("view"))


# ---------------------------------------------------------------- predictions, baselines and results


@query(f"""WITH {E} SELECT 'i' || (event_id % 97) AS id, CAST(max(event_id) AS VARCHAR) AS pred_l0 FROM e WHERE k % 10 <> 3 AND event_id % 97 <> 5 GROUP BY 1""")
def predictions_reader(spark, d):
    """Lines in order of the events, file after file: broken ones, ones without id, and several of one id, the last of which counts."""
    at = f"{files.scratch(spark, 'predictions')}/lines"
    ident = F.when(F.col("event_id") % 97 == 5, "").otherwise(F.concat(F.lit("i"), F.col("event_id") % 97))
    line = F.when(F.col("k") % 10 == 3, "{broken").otherwise(F.to_json(F.struct(ident.alias("id"), F.col("event_id").cast("string").alias("pred_l0"))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = events(spark, d).select("event_id", line.alias("value")).repartitionByRange(parts, "event_id").sortWithinPartitions("event_id")
    lines.select("value").write.text(at, lineSep="\n")  # part files are named in order
    return R.predictions(spark, at).select("id", "pred_l0")


@query(f"""WITH {E}, p AS (SELECT event_id, 'g' || (user_id % 6) AS g, CASE WHEN user_id % 6 < 3 THEN 'new' ELSE 'old' END AS says, 'i' || (k % 50) AS id FROM e),
o AS (SELECT id, arg_max(says, event_id) AS says, max(event_id) AS n FROM p GROUP BY id), w AS (SELECT 'i' || i AS id, 49 - i AS place FROM range(0, 40) t(i))
SELECT o.id, says, row_number() OVER (ORDER BY place NULLS LAST, n) AS position FROM o LEFT JOIN w ON w.id = o.id""")
def predictions_rewritten(spark, d):
    """Groups written, half of them again, read back, and put in the order of the samples."""
    at = files.scratch(spark, "predictions")
    rows = events(spark, d).select(F.concat(F.lit("i"), F.col("k") % 50).alias("id"), F.col("event_id").alias("ord"), F.concat(F.lit("g"), F.col("user_id") % 6).alias("g"))
    K.write_predictions(rows.withColumn("says", F.lit("old")), at, ["g"])
    K.write_predictions(rows.where("g in ('g0', 'g1', 'g2')").withColumn("says", F.lit("new")), at, ["g"])
    back = spark.read.schema("id string, ord long, says string, g string").json(at)
    wanted = spark.range(40).select(F.concat(F.lit("i"), "id").alias("id"), (49 - F.col("id")).alias("ord"))
    return K.in_sample_order(back, wanted).select("id", "says", "position")


def _split(spark, d):
    rows = samples(spark, d)
    test = F.col("ord") % 5 == 0
    return rows.where(~test), rows.where(test)


_TEST = f"{_SAMPLE}, t AS (SELECT event_id AS id, event_id % 5 = 0 AS test, role, tp, l2 AS seg, l0 AS gt_l0, l1 AS gt_l1, l2_says AS gt_l2, {_ID} AS name FROM s)"
_MOST = "(SELECT {0} FROM t WHERE NOT test GROUP BY {0} ORDER BY count(*) DESC, min(id) LIMIT 1)"


@query(f"""WITH {_TEST} SELECT 'majority_class' AS baseline, name AS id, seg AS l2_segment_id, {", ".join(f"{_MOST.format(f'gt_l{i}')} AS pred_l{i}" for i in range(3))}, gt_l0 FROM t WHERE test
UNION ALL SELECT 'copy_last', name, seg, {", ".join(f"lag(gt_l{i}, 1, '') OVER (PARTITION BY role, seg ORDER BY tp, id)" for i in range(3))}, gt_l0 FROM t WHERE test""")
def baseline_files(spark, d):
    at = files.scratch(spark, "baselines")
    made = L.baseline_predictions(*_split(spark, d))
    K.write_baselines(made, at)
    schema = "id string, role string, tp_id string, l2_segment_id string, pred_l0 string, pred_l1 string, pred_l2 string, gt_l0 string, gt_l1 string, gt_l2 string"
    read = lambda name: spark.read.schema(schema).json(f"{at}/{name}").withColumn("baseline", F.lit(name))
    return read("majority_class").unionByName(read("copy_last")).select("baseline", "id", "l2_segment_id", "pred_l0", "pred_l1", "pred_l2", "gt_l0")


@query(f"""WITH {_TEST}, c AS (SELECT {", ".join(f"gt_l{i}, lag(gt_l{i}, 1, '') OVER (PARTITION BY role, seg ORDER BY tp, id) AS p{i}" for i in range(3))} FROM t WHERE test)
SELECT count(*) AS matched, count(*) AS total_predictions, round(avg((gt_l2 = p2)::INT), 9) AS l2_exact_match, round(avg((gt_l0 = p0)::INT), 9) AS l0_same FROM c""")
def results_file(spark, d):
    """The results document of a baseline, written, and read again by name."""
    at = files.scratch(spark, "results")
    _, test = _split(spark, d)
    pred = L.copy_last(test.withColumn("l2_segment_id", F.col("gt_l2_seg_id"))).select("id", "pred_l0", "pred_l1", "pred_l2")
    same = M.batch_score(lambda refs, hyps: [float(a == b) for a, b in zip(refs, hyps, strict=True)])
    K.write_results(M.evaluate(pred, test, scorers={"same": same, "exact_match": M.exact_match}), at)
    got = spark.read.schema("matched long, total_predictions long, l0 struct<same:double>, l2_exact_match double").option("multiLine", "true").json(f"{at}/results.json")
    return got.select("matched", "total_predictions", F.round("l2_exact_match", 9).alias("l2_exact_match"), F.round("l0.same", 9).alias("l0_same"))


@query(f"""WITH {E} SELECT event_type, count(*) AS n, count(*) AS entries FROM e GROUP BY event_type""")
def table_and_history(spark, d):
    """A table that is overwritten from itself, and a log of what was done to it."""
    at = files.scratch(spark, "edited")
    counts = events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    counts.withColumn("n", F.col("n") - 1).write.parquet(f"{at}/table")
    K.overwrite_safely(spark.read.parquet(f"{at}/table").withColumn("n", F.col("n") + 1), f"{at}/table")
    log = [f'{{"type": "{r["event_type"]}", "n": {r["n"]}, "timestamp": "T"}}' for r in counts.collect()]  # a row per type
    K.append_history(spark, f"{at}/history", log)
    kept = spark.read.parquet(f"{at}/history").select(F.get_json_object("entry", "$.type").alias("event_type"), F.get_json_object("entry", "$.n").cast("long").alias("entries"))
    return spark.read.parquet(f"{at}/table").join(kept, "event_type").select("event_type", "n", "entries")


@query(f"""WITH {E}, v AS (SELECT unnest([1, 2, 3]) AS version) SELECT version, event_type, n * least(version, 2) AS n, ['made', 'doubled', 'seen'][version] AS did FROM v, (SELECT event_type, count(*) AS n FROM e GROUP BY event_type)""")
def snapshots_of_a_table(spark, d):
    """Every version of a table that is overwritten from itself and noted upon, with what the log says of it."""
    store = N.Snapshots(spark, files.scratch(spark, "snapshots"))
    store.overwrite(events(spark, d).groupBy("event_type").agg(F.count("*").alias("n")), {"did": "made"})
    store.overwrite(store.read().withColumn("n", F.col("n") * 2), {"did": "doubled"})
    store.note({"did": "seen"})
    every = None
    for number in range(1, store.version() + 1):
        rows = store.read(number).withColumn("version", F.lit(number).cast("long"))
        every = rows if every is None else every.unionByName(rows)
    return every.join(F.broadcast(store.history()), "version").select("version", "event_type", "n", F.get_json_object("entry", "$.did").alias("did"))  # a row per version


@query("""SELECT conv_id, turn, 'told ' || text AS answer FROM conversations""")
def batched_answers(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").withColumn("p", F.concat(F.lit("said "), "text"))
    return P.answer_batch(rows, "p", lambda prompts: [f"<think>{len(p)}</think> Assistant\n{p.replace('said', 'told', 1)}\n" for p in prompts]).select("conv_id", "turn", "answer")


@query("""SELECT conv_id, turn, 'system' AS first, 'Be brief.' AS rule, 'user' AS second, text AS asked FROM conversations""")
def chat_messages(spark, d):
    m = F.col("m")
    rows = spark.read.parquet(f"{d}/conversations.parquet").withColumn("m", T.chat_messages(F.lit("Be brief."), F.col("text")))
    return rows.select("conv_id", "turn", m[0]["role"].alias("first"), m[0]["content"].alias("rule"), m[1]["role"].alias("second"), m[1]["content"].alias("asked"))


# ---------------------------------------------------------------- hierarchies

_STATE = f"""st AS (SELECT take, tp_id, subj AS role, coalesce(array_to_string(list_sort(list(DISTINCT pred || ':' || obj) FILTER (WHERE pred IN ('Touching', 'Holding', 'Sawing'))), ';'), '') AS state
FROM {_LABELS} WHERE subj IN ('head_surgeon', 'nurse', 'mps') GROUP BY take, tp_id, subj)"""
_SEG = f"""{_X}, {_STATE}, {debounce_sql("st", "sg", "state", "take, role", "tp_id")},
l0 AS (SELECT take, role, run - 1 AS ord, any_value(sm) AS state, min(tp_id) AS tp_start, max(tp_id) AS tp_end, count(*) AS n FROM sg GROUP BY take, role, run),
z AS (SELECT l0.*, printf('%s_L0_%03d', role, ord) AS segment_id, a.b * 10 AS time_start, c.b * 10 AS time_end FROM l0 JOIN fm a ON a.take = l0.take AND a.tp_id = tp_start JOIN fm c ON c.take = l0.take AND c.tp_id = tp_end)"""
_NAME = "CASE role WHEN 'head_surgeon' THEN 'head surgeon' WHEN 'nurse' THEN 'scrub nurse' ELSE 'robot technician (MPS)' END"
_SAYS = "replace(replace(replace(replace(replace(replace(state, 'Touching:', 'is touching '), 'Holding:', 'is holding '), 'Sawing:', 'is sawing '), 'saw;', 'bone saw;'), 'drill;', 'drill;'), ';', '; ')"


def _line(spark, d):
    root = tree(spark, d)
    frames = R.frame_map(spark, root).where(T.is_take(F.col("take")))
    labels = R.relation_labels(spark, root, frames).where("tp_id < '900000'")
    return root, frames, labels, S.role_timeline(labels.select("take", "tp_id", F.inline("triplets")))


@query(f"""WITH {_SEG} SELECT take, segment_id, tp_start, tp_end, n AS duration_frames, time_start, time_end, time_end - time_start + 1 AS duration_s,
  {_NAME} || ': ' || CASE WHEN state = '' THEN 'no active interactions' ELSE regexp_replace({_SAYS}, 'is ([a-z]+) saw$', 'is \\1 bone saw') END AS description,
  coalesce((SELECT string_agg('says ' || f.b || CASE WHEN z.take[3]::INT % 2 = 1 THEN ' beside' ELSE '' END, '/' ORDER BY f.b) FROM fm f WHERE f.take = z.take AND f.b * 10 + 12 >= z.time_start AND f.b * 10 + 3 <= z.time_end), '') AS heard FROM z""")
def level0_of_recordings(spark, d):
    root, frames, _, line = _line(spark, d)
    rows = H.level0(line, frames, R.transcripts(spark, root))
    long = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    return rows.select("take", "segment_id", "tp_start", "tp_end", *long("duration_frames", "time_start", "time_end", "duration_s"), "description", F.array_join(F.transform("transcript", lambda t: t["text"]), "/").alias("heard"))


def _pairs(segments):
    """Two segments each."""
    ids = segments["segment_id"].tolist()
    return [{"segment_ids": [f" [{x}]" for x in ids[i : i + 2]], "summary": f"of {ids[i]}", "audio_summary": ""} for i in range(0, len(ids), 2)]


def _tables(spark, d):
    """Hierarchies whose steps are pairs of segments and whose phases are pairs of steps, as a model might group them."""
    key = (spark.sparkContext.applicationId, d, "tables")
    if key in _ROOTS:
        return {n: spark.read.parquet(f"{_ROOTS[key]}/{n}") for n in ("l0", "l1", "l2", "metadata", "analysis")}
    root, frames, labels, _ = _line(spark, d)
    frames = files.materialise(frames, "frames")
    labels = files.materialise(labels, "labels")  # label files are read once
    line = files.materialise(S.role_timeline(labels.select("take", "tp_id", F.inline("triplets"))), "line")
    l0 = H.level0(line, frames)
    l1 = H.model_level(l0, 1, _pairs, chunked=False)
    tables = {"l0": l0, "l1": l1, "l2": H.model_level(l1, 2, _pairs, chunked=False)}
    at = files.scratch(spark, "tables")
    for name in tables:
        tables[name].write.mode("overwrite").parquet(f"{at}/{name}")
        tables[name] = spark.read.parquet(f"{at}/{name}")
        l1 = tables["l1"]
        if name == "l1":
            tables["l2"] = H.model_level(l1, 2, _pairs, chunked=False)
    H.metadata(tables, labels, frames, root).write.parquet(f"{at}/metadata")
    H.debounce_analysis(line, frames).write.parquet(f"{at}/analysis")
    _ROOTS[key] = at
    return _tables(spark, d)


@query(f"""WITH {_SEG}, g AS (SELECT take, role, ord // 2 AS i, min(time_start) AS a, max(time_end) AS b, string_agg(segment_id, ',' ORDER BY ord) AS children, min(ord) AS first FROM z GROUP BY take, role, ord // 2)
SELECT 1 AS level, take, printf('%s_L1_%03d', role, i) AS segment_id, children, 'of ' || printf('%s_L0_%03d', role, first) AS summary, a AS time_start, b AS time_end, b - a + 1 AS duration_s FROM g
UNION ALL SELECT 2, take, printf('%s_L2_%03d', role, i // 2), string_agg(printf('%s_L1_%03d', role, i), ',' ORDER BY i), 'of ' || printf('%s_L1_%03d', role, min(i)), min(a), max(b), max(b) - min(a) + 1 FROM g GROUP BY take, role, i // 2""")
def grouped_by_a_model(spark, d):
    t = _tables(spark, d)
    pick = lambda x: x.select("level", "take", "segment_id", F.array_join("children", ",").alias("children"), "summary", *(F.col(c).cast("long").alias(c) for c in ("time_start", "time_end", "duration_s")))
    return pick(t["l1"]).unionByName(pick(t["l2"]))


_HEARD = """h AS (SELECT z.take, z.role, z.ord, f.b, 'says ' || f.b || CASE WHEN z.take[3]::INT % 2 = 1 THEN ' beside' ELSE '' END AS says
  FROM z JOIN fm f ON f.take = z.take AND f.b * 10 + 12 >= z.time_start AND f.b * 10 + 3 <= z.time_end)"""


@query(f"""WITH {_SEG}, {_HEARD}
SELECT level, z.take, printf('%s_L%d_%03d', z.role, level, z.ord // (2 * level)) AS segment_id, coalesce(string_agg(says, '/' ORDER BY z.ord, h.b), '') AS heard, count(says) AS n
FROM z CROSS JOIN (SELECT unnest([1, 2]) AS level) LEFT JOIN h ON h.take = z.take AND h.role = z.role AND h.ord = z.ord GROUP BY level, z.take, z.role, z.ord // (2 * level)""")
def words_up_the_tree(spark, d):
    """What was said during steps and phases: the words of their segments, one after the other."""
    root, frames, _, line = _line(spark, d)
    l0 = files.materialise(H.level0(files.materialise(line, "line"), frames, R.transcripts(spark, root)), "l0")
    l1 = files.materialise(H.model_level(l0, 1, _pairs, chunked=False), "l1")
    l2 = H.model_level(l1, 2, _pairs, chunked=False)
    pick = lambda t: t.select(F.col("level").cast("long").alias("level"), "take", "segment_id", F.array_join(F.transform("transcript", lambda x: x["text"]), "/").alias("heard"), F.size("transcript").cast("long").alias("n"))
    return pick(l1).unionByName(pick(l2))


@query(f"""WITH {_X}, l AS (SELECT DISTINCT take, tp_id, subj, pred, obj FROM {_LABELS}),
p AS (SELECT take, tp_id, subj AS role, pred || ':' || obj AS item FROM l WHERE pred IN ('Touching', 'Holding', 'Sawing') AND subj IN ('head_surgeon', 'nurse', 'mps')),
people AS (SELECT DISTINCT l.take, l.tp_id, l.subj AS role, item FROM l LEFT JOIN p ON p.take = l.take AND p.tp_id = l.tp_id AND p.role = l.subj WHERE l.subj IN ('head_surgeon', 'nurse', 'mps')),
o AS (SELECT take, tp_id, obj AS role, CASE WHEN pred IN ('Touching', 'Holding', 'Sawing') THEN pred || ':' || subj END AS item FROM l WHERE obj IN ('drill', 'saw')
  UNION SELECT take, tp_id, 'saw', pred || ':' || subj FROM l WHERE pred = 'Sawing'),
s AS (SELECT take, tp_id, role, coalesce(array_to_string(list_sort(list(DISTINCT item) FILTER (WHERE item IS NOT NULL)), ';'), '') AS state FROM (SELECT * FROM people UNION ALL SELECT * FROM o) GROUP BY ALL),
{_SCREENS}, ph AS (SELECT take, b, tp_id, CASE WHEN take[3]::INT % 2 = 0 THEN 'P' WHEN b % 2 = 0 THEN 'B' ELSE 'A' END || (b % 5) AS phase FROM fm),
seen AS (SELECT DISTINCT take, tp_id FROM l UNION SELECT DISTINCT take, '999999' FROM fm)
SELECT kind, count(*) AS n, count(DISTINCT take) AS takes, count(DISTINCT role) AS roles, CAST(sum(length(state)) AS BIGINT) AS letters FROM (
  SELECT CASE WHEN role IN ('drill', 'saw') THEN 'tool' ELSE 'person' END AS kind, take, role, state FROM s
  UNION ALL SELECT 'robot', ph.take, 'robot_setup', 'Phase:' || phase FROM ph JOIN seen USING (take, tp_id)
  UNION ALL SELECT 'robot', fm.take, 'robot_monitor', concat_ws(';', 'Phase:' || sc.phase, 'Step:' || sc.step) FROM fm JOIN seen USING (take, tp_id) JOIN sc ON sc.take = fm.take AND sc.s = fm.b // 2 WHERE sc.phase IS NOT NULL OR sc.step IS NOT NULL) GROUP BY kind""")
def timelines_of_all_roles(spark, d):
    """People, tools and robots of the recordings together."""
    root, frames, _, _ = _line(spark, d)
    line = H.timelines(spark, root, R.relation_labels(spark, root, frames), frames)
    kind = F.when(F.col("role").isin(*V.ROBOTS), "robot").when(F.col("role").isin(*V.TOOLS), "tool").otherwise("person")
    text = F.array_join(F.transform("state", lambda x: F.concat(x["p"], F.lit(":"), x["o"])), ";")
    return line.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("take").alias("takes"), F.countDistinct("role").alias("roles"), F.sum(F.length(text)).alias("letters"))


@query(SQL["grouped_by_a_model"].replace("FROM z GROUP BY take, role, ord // 2)", "FROM z WHERE take IN (SELECT take FROM fm GROUP BY take HAVING count(*) >= 9) GROUP BY take, role, ord // 2)"))
def hierarchies_built(spark, d):
    """From the recording folders to steps and phases in one call; of all roles, the people are held against SQL."""
    made = H.build(spark, tree(spark, d), groupers=(_pairs, _pairs))
    pick = lambda x: x.where(F.col("role").isin("head_surgeon", "nurse", "mps")).select(F.col("level").cast("long").alias("level"), "take", "segment_id", F.array_join("children", ",").alias("children"), "summary", *(F.col(c).cast("long").alias(c) for c in ("time_start", "time_end", "duration_s")))
    return pick(made["l1"]).unionByName(pick(made["l2"]))


_SAID = "regexp_replace({0}, 'is ([a-z]+) saw$', 'is \\1 bone saw')".format(_SAYS)
_PHASES = _MEMORY.removeprefix(_FRAMES + ",\n").replace("PARTITION BY user_id ORDER BY ts, event_id", "PARTITION BY take, role, l2id ORDER BY tp")


@query(f"""WITH {_SEG}, t AS (SELECT *, unnest(range(CAST(tp_start AS INT), CAST(tp_end AS INT) + 1)) AS tp, {_NAME} AS human, {_NAME} || ': ' || CASE WHEN state = '' THEN 'no active interactions' ELSE {_SAID} END AS says FROM z),
f AS (SELECT take, role, human, tp, printf('%06d', tp) AS tp_id, printf('%s_L2_%03d', role, ord // 4) AS l2id, says AS l0, 'of ' || printf('%s_L0_%03d', role, ord // 2 * 2) AS l1, 'of ' || printf('%s_L1_%03d', role, ord // 4 * 2) AS l2 FROM t),
{_PHASES}
SELECT o.take || '/' || role || '/' || l2id || '/' || o.tp_id AS id, CASE o.take WHEN '900_PKA' THEN 'train' WHEN '901_PKA' THEN 'val' ELSE 'test' END AS split, printf('colorimage/camera04_colorimage-%06d.jpg', fm.b) AS image,
  '<image>' || chr(10) || 'Role: ' || human || chr(10) || CASE WHEN memory = '' THEN '' ELSE memory || chr(10) END || 'Describe the current activity hierarchy for this role.' AS asked, 'L0: ' || l0 || ' | L1: ' || l1 || ' | L2: ' || l2 AS answer
FROM o JOIN fm ON fm.take = o.take AND fm.tp_id = o.tp_id WHERE fm.b % 5 <> 2""")
def training_samples(spark, d):
    """From hierarchies to samples in one call; a fifth of the frames lacks a view."""
    _, frames, _, _ = _line(spark, d)
    there = frames.select("take", F.explode(T.image_paths(F.col("azure").cast("long"), tuple(V.CAMERAS.values()))).alias("path"), F.col("azure").cast("long").alias("b")).where("b % 5 <> 2 or path not like '%camera03%'")
    made = B.build_samples(_tables(spark, d), frames, there, splits={"900_PKA": "train", "901_PKA": "val"}, default="test")
    return made.select("id", "split", F.col("image")[3].alias("image"), F.col("conversations")[0]["value"].alias("asked"), F.col("conversations")[1]["value"].alias("answer"))


@query(f"""WITH {_SEG}, k AS (SELECT take, role, max(raw) AS raw, max(run) AS run FROM sg GROUP BY take, role), q AS (SELECT take, sum(raw) AS raw, sum(run) AS run FROM k GROUP BY take),
m AS (SELECT take, count(DISTINCT role) AS roles, count(*) AS n0, sum((ord % 2 = 0)::INT) AS n1, sum((ord % 4 = 0)::INT) AS n2 FROM z GROUP BY take),
p AS (SELECT take, min(tp_id) AS a, max(tp_id) AS b, count(DISTINCT tp_id) AS n FROM {_LABELS} GROUP BY take)
SELECT m.take, roles AS total_roles, n0 AS total_level0_segments, CAST(n1 AS BIGINT) AS total_level1_segments, CAST(n2 AS BIGINT) AS total_level2_segments, p.a || '-' || p.b AS tp_range, p.n AS num_timepoints,
  (SELECT b * 10 FROM fm WHERE fm.take = m.take AND tp_id = p.a) || '-' || (SELECT b * 10 FROM fm WHERE fm.take = m.take AND tp_id = p.b) AS time_range,
  CAST(raw AS BIGINT) AS segments_without_debounce, CAST(run AS BIGINT) AS segments_with_debounce, CAST(raw - run AS BIGINT) AS segments_removed, CAST((SELECT raw - run FROM k WHERE k.take = m.take AND role = 'nurse') AS BIGINT) AS nurse_removed,
  CAST((SELECT nullif(count(*), 0) FROM z WHERE z.take = m.take AND role = 'nurse') AS BIGINT) AS nurse_segments
FROM m JOIN q ON q.take = m.take JOIN p ON p.take = m.take""")
def hierarchy_documents(spark, d):
    """Documents committed as a set and read again: numbers of segments, ranges, and the counts of the debounce analysis."""
    at = K.commit_documents(H.documents(_tables(spark, d)), files.scratch(spark, "hierarchies"))
    meta = "total_roles:bigint,total_level0_segments:bigint,total_level1_segments:bigint,total_level2_segments:bigint,tp_range:array<string>,num_timepoints:bigint,time_range:array<bigint>"
    found = "segments_without_debounce:bigint,segments_with_debounce:bigint,segments_removed:bigint,per_role:map<string,struct<removed:bigint>>"
    docs = spark.read.text(f"{at}/*_hierarchy.json", wholetext=True).select(T.take_of_file(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).alias("take"), F.from_json("value", f"metadata struct<{meta}>, debounce_analysis struct<{found}>, roles map<string,struct<num_segments:bigint>>").alias("h"))
    rows = docs.select("take", "h.metadata.*", "h.debounce_analysis.*", F.col("h.roles")["nurse"]["num_segments"].alias("nurse_segments"))
    dash = lambda c: F.concat(F.col(c)[0].cast("string"), F.lit("-"), F.col(c)[1].cast("string")).alias(c)
    return rows.select("take", *(f"total_{x}" for x in ("roles", "level0_segments", "level1_segments", "level2_segments")), dash("tp_range"), "num_timepoints", dash("time_range"), "segments_without_debounce", "segments_with_debounce", "segments_removed", F.col("per_role")["nurse"]["removed"].alias("nurse_removed"), "nurse_segments")


@query(f"""WITH {_SEG} SELECT take, role, segment_id, ord, tp_start, tp_end, state, {_NAME} AS role_human FROM z""")
def hierarchy_reader(spark, d):
    at = files.scratch(spark, "hierarchies")
    K.write_documents(H.documents(_tables(spark, d)), at)
    rows = R.hierarchies(spark, f"{at}/*.json")["l0"]
    state = F.array_join(F.transform("active_predicates", lambda x: F.concat_ws(":", x)), ";")
    return rows.select("take", F.col("role_key").alias("role"), "segment_id", F.col("ord").cast("long").alias("ord"), "tp_start", "tp_end", state.alias("state"), "role_human")


@query(f"""WITH {_SEG}, w AS (SELECT *, lag(state) OVER (PARTITION BY take, role ORDER BY ord) AS prev FROM z),
r AS (SELECT *, sum((state <> coalesce(prev, ''))::INT) OVER (PARTITION BY take, role ORDER BY ord) AS g0, min(ord) OVER (PARTITION BY take, role) AS lo FROM w),
q AS (SELECT *, g0 - first_value(g0) OVER (PARTITION BY take, role ORDER BY ord) AS g FROM r)
SELECT take, printf('%s_L1_%03d', role, CAST(g AS BIGINT)) AS segment_id, min(time_start) AS time_start, max(time_end) AS time_end, string_agg(segment_id, ',' ORDER BY ord) AS children,
  CASE WHEN any_value(state) = '' THEN 'idle / no active interactions' ELSE any_value((SELECT string_agg(t, '; ' ORDER BY t) FROM (SELECT unnest(string_split(regexp_replace({_SAYS}, 'is ([a-z]+) saw$', 'is \\1 bone saw'), '; ')) AS t))) END AS summary FROM q GROUP BY take, role, g""")
def steps_by_distance(spark, d):
    """Steps by the distance of their texts, under an encoder for which texts are the same or far apart."""
    import zlib

    import numpy as np

    def encoder(texts):
        out = np.zeros((len(texts), 4096))
        out[np.arange(len(texts)), [zlib.crc32(t.encode()) % 4096 for t in texts]] = 1
        return out

    _, frames, _, line = _line(spark, d)
    rows = H.group_level(H.level0(line, frames).withColumn("items", F.col("active_predicates")), 1, 0.3, encoder)
    return rows.select("take", "segment_id", F.col("time_start").cast("long").alias("time_start"), F.col("time_end").cast("long").alias("time_end"), F.array_join("children", ",").alias("children"), "summary")


_LINES = """string_agg('  [' || segment_id || '] t=' || time_start || 's-' || time_end || 's (' || (time_end - time_start + 1) || {0}, chr(10) ORDER BY ord)"""


@query(f"""WITH {_SEG} SELECT take, role, 'Level-0 segments for ' || {_NAME} || ':' || chr(10) || chr(10) || {_LINES.format(f"'s): ' || {_NAME} || ': ' || CASE WHEN state = '' THEN 'no active interactions' ELSE regexp_replace({_SAYS}, 'is ([a-z]+) saw$', 'is ' || chr(92) || '1 bone saw') END || chr(10) || '      Speech: —'")} || chr(10) || chr(10) || 'Group these into action steps. Output JSON only.' AS prompt,
  'Level-1 action steps for ' || {_NAME} || ':' || chr(10) || chr(10) || 'Note: "' || {_NAME} || '" is a surgical instrument/tool, not a person. Focus summaries on this tool''s usage lifecycle.' || chr(10) || chr(10) || {_LINES.format("'s, 2 L0 segments): does ' || ord || chr(10) || '      Audio: ' || CASE WHEN ord % 2 = 0 THEN '(no verbal communication)' ELSE 'hums' END")} || chr(10) || chr(10) || 'Group these into surgical phases. Output JSON only.' AS steps
FROM z GROUP BY take, role""")
def grouping_prompts(spark, d):
    _, frames, _, line = _line(spark, d)
    rows = H.level0(line, frames)
    packed = lambda *extra: F.array_sort(F.collect_list(F.struct("ord", "segment_id", "time_start", "time_end", "duration_s", *extra)))
    step = [F.concat(F.lit("does "), "ord").alias("summary"), F.when(F.col("ord") % 2 == 0, "").otherwise("hums").alias("audio_summary"), F.array("segment_id", "segment_id").alias("children")]
    by_role = rows.groupBy("take", "role").agg(packed("description", "transcript").alias("s"), packed(*step).alias("t"))
    return by_role.select("take", "role", H.segment_prompt(F.col("role"), F.col("s"), F.lit(False)).alias("prompt"), H.step_prompt(F.col("role"), F.col("t"), F.lit(True)).alias("steps"))


# ---------------------------------------------------------------- what a viewer reads


@query(f"""WITH {_X}, g AS (SELECT l.take, f.b * 10 AS ts, string_agg(subj || ':' || obj, ';' ORDER BY event_id) AS graph FROM {_LABELS} l JOIN fm f ON f.take = l.take AND f.tp_id = l.tp_id WHERE l.tp_id >= '000002' GROUP BY l.take, f.b)
SELECT take, ts, graph FROM g""")
def scene_graphs_by_second(spark, d):
    _, frames, labels, _ = _line(spark, d)
    return W.scene_graphs(labels, frames, "000002").select("take", F.col("ts").cast("long").alias("ts"), F.array_join(F.transform("triplets", lambda t: F.concat_ws(":", t["subj"], t["obj"])), ";").alias("graph"))


_SHOWN = {"head_surgeon": "person", "nurse": "person", "patient": "person", "drill": "tool", "saw": "tool", "hammer": "tool", "robot_monitor": "robot"}


@query(f"""WITH {_X}, t AS (SELECT l.take, subj, obj, f.b * 10 AS ts FROM {_LABELS} l JOIN fm f ON f.take = l.take AND f.tp_id = l.tp_id)
SELECT DISTINCT take, '*' AS role, ts FROM t
UNION ALL SELECT DISTINCT take, subj, ts FROM t WHERE subj IN ('head_surgeon', 'nurse', 'patient')
UNION ALL SELECT DISTINCT take, r.role, ts FROM t, (SELECT unnest(['drill', 'saw']) AS role) r WHERE subj = r.role OR obj = r.role
UNION ALL SELECT DISTINCT take, r.role, ts FROM t, (SELECT unnest(['hammer', 'robot_monitor']) AS role) r""")
def valid_times_by_role(spark, d):
    """People by what they do, tools by what is done with them, a tool that never appears and a robot at all times."""
    _, frames, labels, _ = _line(spark, d)
    kinds = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.lit(k == "robot").alias("is_robot"), F.lit(k == "tool").alias("is_tool")) for r, k in _SHOWN.items()))).alias("x")
    graphs = W.scene_graphs(labels, frames)
    roles = graphs.select("take").distinct().select("take", kinds).select("take", "x.*")
    return W.valid_times(graphs, roles).select("take", F.coalesce("role", F.lit("*")).alias("role"), F.col("ts").cast("long").alias("ts"))


@query(f"""WITH {_SEG}, k AS (SELECT take, role, {_NAME} AS role_human, count(*) AS n FROM z WHERE ord % 5 <> 1 GROUP BY take, role)
SELECT take, role, role_human, CAST(row_number() OVER (PARTITION BY take ORDER BY role) AS INT) AS place, n FROM k""")
def shown_roles(spark, d):
    from pyspark.sql import Window

    t = _tables(spark, d)
    untimed = t["l0"].withColumn("time_end", F.when(F.col("ord") % 5 != 1, F.col("time_end")))
    roles, l0, _, _ = W.shown_roles(untimed, t["l1"], t["l2"])
    place = F.row_number().over(Window.partitionBy("take").orderBy("place"))
    return roles.join(l0.groupBy("take", "role").agg(F.count("*").alias("n")), ["take", "role"]).select("take", "role", "role_human", place.alias("place"), "n")


_MONITOR = f"{_X}, {_SCREENS}, mo AS (SELECT fm.take, tp_id, b, coalesce(phase, '') AS phase, coalesce(step, '') AS step FROM fm JOIN sc ON sc.take = fm.take AND sc.s = fm.b // 2 WHERE phase IS NOT NULL OR step IS NOT NULL)"


@query(f"""WITH {_MONITOR}, r AS (SELECT *, phase || '|' || step AS state FROM mo), {debounce_sql("r", "sg", "state", "take", "tp_id")},
g AS (SELECT take, run, any_value(sm) AS state, min(b) * 10 AS time_start, max(b) * 10 AS time_end FROM sg GROUP BY take, run)
SELECT take, time_start, time_end, CASE WHEN split_part(state, '|', 1) = '' THEN 'idle' WHEN split_part(state, '|', 2) = '' THEN split_part(state, '|', 1) ELSE split_part(state, '|', 1) || ' · ' || split_part(state, '|', 2) END AS label FROM g""")
def monitor_timeline(spark, d):
    root, frames, labels, line = _line(spark, d)
    every = H.timelines(spark, root, R.frame_map(spark, root).where(T.is_take(F.col("take"))).select("take", "tp_id", F.array().cast("array<struct<subj:string,pred:string,obj:string>>").alias("triplets")), frames, tools=False)
    l0 = H.level0(every.where("role = 'robot_monitor'"), frames)
    return W.robot_timeline(l0).select("take", F.col("time_start").cast("long").alias("time_start"), F.col("time_end").cast("long").alias("time_end"), "label")


@query(f"""WITH {E}, g AS (SELECT user_id, event_id, sec AS a, CASE WHEN k % 5 = 0 THEN sec - 1 ELSE sec + k * 60 END AS b FROM e WHERE event_type = 'click'), v AS (SELECT user_id, event_id AS other, sec FROM e WHERE event_type = 'signup')
SELECT g.event_id, other FROM g LEFT JOIN v ON v.user_id = g.user_id AND v.sec BETWEEN a AND b""")
def overlap_with_unmatched(spark, d):
    ev = events(spark, d)
    left = ev.where("event_type = 'click'").select("user_id", "event_id", F.col("sec").alias("a"), F.when(F.col("k") % 5 == 0, F.col("sec") - 1).otherwise(F.col("sec") + F.col("k") * 60).alias("b"))
    right = ev.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("other"), F.col("sec").alias("s"), F.col("sec").alias("e"))
    return J.overlapping(left, right, ["user_id"], ("a", "b"), ("s", "e"), how="left").select("event_id", "other")


_CHUNKED = "c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


@query(f"""WITH {_CHUNKED}, h AS (SELECT *, CAST(greatest(0, ceil((n - 30) / 27)) AS BIGINT) AS final FROM c), o AS (SELECT *, least(final, pos // 27) AS chunk FROM h)
SELECT user_id, chunk AS ord, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM o GROUP BY user_id, chunk""")
def chunked_groups(spark, d):
    """One group a chunk: ids that two chunks share belong to the later."""
    from pyspark.sql import Window

    rows = events(spark, d).select("user_id", F.col("event_id").cast("string").alias("segment_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("ord"))
    got = G.group_table(rows, ["user_id"], lambda part: [{"segment_ids": part["segment_id"].tolist(), "summary": "s"}])
    ids = F.transform("segment_ids", lambda x: x.cast("long"))
    return got.select("user_id", F.col("ord").cast("long").alias("ord"), F.size("segment_ids").cast("long").alias("n"), F.array_min(ids).alias("first_id"), F.array_max(ids).alias("last_id"))
