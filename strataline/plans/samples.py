"""Queries for clustering, memory, samples, assembly, baselines and metrics, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import stem as N
from ..functions import text as T
from ..operators import assemble as A
from ..operators import baselines as L
from ..operators import islands as I
from ..operators import memory as Y
from ..sources import sinks as K
from .timelines import E, events, runs_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- clustering

_DIST = """d AS (SELECT label, vec_id, 1 - list_cosine_similarity(CAST(lag(embedding) OVER w AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS distance FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))"""
_GROUP = "WITH " + _DIST + " SELECT label, vec_id, CAST(sum(CASE WHEN distance > {0} THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM d"


def _cluster(spark, d, threshold):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("label", "vec_id", "embedding")
    return I.adjacent_groups(rows, "label", "vec_id", "embedding", threshold).select("label", "vec_id", F.round("distance", 6).alias("distance"), F.col("group").cast("long").alias("grp"))


@query(f"WITH {_DIST} SELECT label, vec_id, round(distance, 6) AS distance FROM d")
def adjacent_cosine(spark, d):
    return _cluster(spark, d, 1.1).drop("grp")


@query(_GROUP.format(1.1))
def adjacent_cluster_l1(spark, d):
    return _cluster(spark, d, 1.1).drop("distance")


@query(_GROUP.format(1.25))
def adjacent_cluster_l2(spark, d):
    return _cluster(spark, d, 1.25).drop("distance")


# ---------------------------------------------------------------- memory and samples

_FRAMES = "f AS (SELECT event_id, user_id, ts, event_type AS l0, 'p' || (k % 2) AS l1 FROM e)"
_MEMORY = f"""{_FRAMES},
v AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN ['+L1:' || l1, '+L0:' || l0]
  ELSE list_concat(CASE WHEN l1 <> lag(l1) OVER w THEN ['-L1:' || lag(l1) OVER w, '+L1:' || l1] ELSE [] END, CASE WHEN l0 <> lag(l0) OVER w THEN ['-L0:' || lag(l0) OVER w, '+L0:' || l0] ELSE [] END) END AS ev
  FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT *, coalesce(flatten(list(ev) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), []) AS prior FROM v),
m AS (SELECT *, prior[-5:] AS short, list_transform(list_filter(prior, lambda x: x[1] = '+'), lambda x: x[2:]) AS plus FROM p),
n AS (SELECT *, list_filter(plus, lambda x, i: list_position(plus, x) = i) AS long FROM m),
o AS (SELECT *, CASE WHEN len(prior) = 0 THEN '' ELSE '<memory_start>' || chr(10) || CASE WHEN len(long) > 0 THEN 'Long: ' || array_to_string(long, '; ') || chr(10) ELSE '' END || 'Short: ' || array_to_string(short, '; ') || chr(10) || '<memory_end>' END AS memory FROM n)"""


def _memory(spark, d):
    frames = events(spark, d).select("event_id", "user_id", "ts", F.col("event_type").alias("l0"), F.concat(F.lit("p"), F.col("k") % 2).alias("l1"))
    return Y.with_memory(frames, ["user_id"], ["ts", "event_id"]).withColumn("memory", T.memory_string(F.col("long_term"), F.col("short_term")))


@query(f"WITH {E}, {_MEMORY} SELECT event_id, array_to_string(long, '; ') AS long_term, array_to_string(short, '; ') AS short_term, memory FROM o")
def temporal_memory(spark, d):
    return _memory(spark, d).select("event_id", F.array_join("long_term", "; ").alias("long_term"), F.array_join("short_term", "; ").alias("short_term"), "memory")


@query(f"""WITH {E}, {_MEMORY} SELECT event_id, '<image>' || chr(10) || body AS prompt, '<im_start><image><im_end>' || chr(10) || body AS wrapped, '<image><image>' || body AS repeated,
  'L0: ' || l0 || ' | L1: ' || l1 || ' | L2: x' AS answer, printf('colorimage/camera01_colorimage-%06d.jpg,colorimage/camera02_colorimage-%06d.jpg', event_id, event_id) AS images
  FROM (SELECT *, 'Role: r' || (user_id % 10) || chr(10) || CASE WHEN memory = '' THEN '' ELSE memory || chr(10) END || 'Describe the current activity hierarchy for this role.' AS body FROM o)""")
def sample_prompts(spark, d):
    rows = _memory(spark, d)
    role = F.concat(F.lit("r"), F.col("user_id") % 10)
    images = T.image_paths(F.col("event_id"), ("camera01", "camera02"))
    forms = [T.prompt(role, F.col("memory"), 2, form).alias(name) for name, form in (("prompt", "sample"), ("wrapped", "wrapped"), ("repeated", "repeated"))]
    return rows.select("event_id", *forms, T.answer(F.col("l0"), F.col("l1"), F.lit("x")).alias("answer"), F.array_join(images, ",").alias("images"))


_U = "('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296.0"
_SOME = """list_filter({0}, lambda x, i: ('0x' || substr(md5('8:' || event_id || ':{0}:' || (i - 1)), 1, 8))::BIGINT / 4294967296.0 > 0.5)"""


@query(f"""WITH {E}, {_MEMORY}, u AS (SELECT event_id, {_U.format("'7:' || event_id")} AS roll, {_SOME.format("long")} AS l, {_SOME.format("short")} AS s FROM o),
pq AS (SELECT event_id, CASE WHEN roll >= 0.667 AND len(l) > 0 THEN 'Long: ' || array_to_string(l, '; ') END AS a, CASE WHEN (roll < 0.667 OR roll >= 0.833) AND len(s) > 0 THEN 'Short: ' || array_to_string(s, '; ') END AS b, roll FROM u)
SELECT event_id, CASE WHEN roll < 0.5 OR (a IS NULL AND b IS NULL) THEN '' ELSE '<memory_start>' || chr(10) || concat_ws(chr(10), a, b) || chr(10) || '<memory_end>' END AS memory FROM pq""")
def augmented_memory(spark, d):
    return _memory(spark, d).select("event_id", T.augment_memory(7, F.col("event_id"), F.col("long_term"), F.col("short_term")).alias("memory"))


@query(f"""WITH v AS (SELECT event_id, unnest([1, 2, 3, 4]) AS i FROM events),
o AS (SELECT event_id, 'camera0' || i AS v, {_U.format("'7:' || event_id || ':' || (i - 1)")} AS u, {_U.format("'8:' || event_id || ':camera0' || i")} >= 0.5 AS kept FROM v),
g AS (SELECT event_id, string_agg(v, ',' ORDER BY u, v) FILTER (WHERE kept) AS chosen, arg_min(v, (u, v)) AS lone FROM o GROUP BY event_id)
SELECT event_id, coalesce(chosen, lone) AS views FROM g""")
def augmented_views(spark, d):
    views = F.array(*(F.lit(f"camera0{i}") for i in range(1, 5)))
    return events(spark, d).select("event_id", F.array_join(T.augment_views(7, F.col("event_id"), views), ",").alias("views"))


_TALK = "conv_id, turn"


@query(f"""WITH c AS (SELECT *, '<image> <image>' || chr(10) || '<memory_start>' || chr(10) || text || chr(10) || '<memory_end>' || chr(10) || 'Ask ' || role AS q FROM conversations)
SELECT {_TALK}, regexp_replace(q, '<memory_start>.*?<memory_end>\\n?', '', 'gs') AS plain, regexp_replace(regexp_replace(q, '<memory_start>.*?<memory_end>\\n?', '', 'gs'), '^(<image>\\s*)+', '') AS bare FROM c""")
def strip_memory(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    q = F.concat(F.lit("<image> <image>\n<memory_start>\n"), "text", F.lit("\n<memory_end>\nAsk "), "role")
    plain = T.strip_memory(q)
    return rows.select("conv_id", "turn", plain.alias("plain"), T.strip_image_tokens(plain).alias("bare"))


@query(f"""WITH c AS (SELECT *, ' <think>' || text || '</think> ' || chr(10) || role || '<think>x</think> y ' AS q, upper(role) || chr(10) || ' said ' AS s FROM conversations)
SELECT {_TALK}, regexp_replace(regexp_replace(q, '<think>.*?</think>', '', 'gs'), '^\\s+|\\s+$', '', 'g') AS answer, 'said' AS said FROM c""")
def strip_think(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    q = F.concat(F.lit(" <think>"), "text", F.lit("</think> \n"), "role", F.lit("<think>x</think> y "))
    return rows.select("conv_id", "turn", T.strip_think(q).alias("answer"), T.drop_speaker(F.concat(F.upper("role"), F.lit("\n said "))).alias("said"))


_PART = "list_filter(list_transform(string_split(q, '|'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: starts_with(x, '{0}:'))"
_LEVEL = "CASE WHEN len({0}) > 0 THEN regexp_replace(list_last({0})[4:], '^\\s+|\\s+$', '', 'g') ELSE '' END"


@query(f"""WITH c AS (SELECT *, CASE turn % 3 WHEN 0 THEN 'L0: ' || text || ' | L1: ' || role || ' | L2: z' WHEN 1 THEN 'L2:  ' || role || '|L0:' || text ELSE text END AS q FROM conversations)
SELECT {_TALK}, {", ".join(f"{_LEVEL.format(_PART.format(x))} AS {x.lower()}" for x in ("L0", "L1", "L2"))} FROM c""")
def parse_output(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    three = F.concat(F.lit("L0: "), "text", F.lit(" | L1: "), "role", F.lit(" | L2: z"))
    q = F.when(F.col("turn") % 3 == 0, three).when(F.col("turn") % 3 == 1, F.concat(F.lit("L2:  "), "role", F.lit("|L0:"), "text")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", T.parse_output(q).alias("p")).select("conv_id", "turn", "p.*")


@query(f"""SELECT {_TALK}, CASE WHEN turn % 4 < 3 THEN 'a' || conv_id || ',b' || turn ELSE '' END AS ids, CASE WHEN turn % 4 < 3 THEN role ELSE '' END AS summary FROM conversations""")
def model_json_groups(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    body = F.concat(F.lit('[{"segment_ids": [" [a'), "conv_id", F.lit(']", "b'), "turn", F.lit('"], "summary": "'), "role", F.lit('"}]'))
    fenced = F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone [1"))
    raw = F.when(F.col("turn") % 4 == 0, body).when(F.col("turn") % 4 == 1, fenced).when(F.col("turn") % 4 == 2, F.concat(F.lit("So: "), body, F.lit(" ok"))).otherwise("no array here")
    got = T.json_array(raw, "array<struct<segment_ids:array<string>,summary:string>>")
    none = F.lit("")
    return rows.select("conv_id", "turn", F.coalesce(F.array_join(T.clean_ids(got[0]["segment_ids"]), ","), none).alias("ids"), F.coalesce(got[0]["summary"], none).alias("summary"))


@query("SELECT CASE o_custkey % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'custom' END AS split, 'c' || (o_custkey % 5) AS take, count(*) AS n FROM orders GROUP BY ALL")
def split_routing_counts(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("c"), F.col("o_custkey") % 5).alias("take"))
    return K.with_split(orders, {"c0": "train", "c1": "val", "c2": "test"}, "custom").groupBy("split", "take").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- assembly

_PRED = "p AS (SELECT 'r' || (user_id % 10) AS role, 'r_L2_00' || (k % 3) AS l2_segment_id, printf('%08d', event_id) AS tp_id, event_type AS l0, 'v' || (CAST(floor(value) AS BIGINT) % 2) AS l1, 'w' || (k % 2) AS l2, CASE WHEN k % 6 > 0 THEN sec END AS time FROM e)"


def _predicted(spark, d):
    rows = events(spark, d)
    return rows.select(F.lit("x").alias("take"), F.concat(F.lit("r"), F.col("user_id") % 10).alias("role"), F.concat(F.lit("r_L2_00"), F.col("k") % 3).alias("l2_segment_id"), F.format_string("%08d", "event_id").alias("tp_id"), F.col("event_type").alias("l0"), F.concat(F.lit("v"), F.floor("value") % 2).alias("l1"), F.concat(F.lit("w"), F.col("k") % 2).alias("l2"), F.when(F.col("k") % 6 > 0, F.col("sec")).alias("time"))


_K = "role, l2_segment_id"
_ENDS = "min(tp_id) AS tp_start, max(tp_id) AS tp_end, count(*) AS n_frames, coalesce(first(time ORDER BY tp_id), 0) AS time_start, coalesce(last(time ORDER BY tp_id), 0) AS time_end"


@query(f"""WITH {E}, {_PRED}, {runs_sql("p", "a", "l1", _K, "tp_id", "orun")}, {runs_sql("a", "b", "l1, l0", _K, "tp_id", "irun")},
i AS (SELECT *, CAST(right(l2_segment_id, 1) AS INT) AS ix FROM b),
c AS (SELECT role, l2_segment_id, l2, count(*) AS n, min(tp_id) AS f FROM p GROUP BY ALL)
SELECT 0 AS level, {_K}, printf('%s_L0_%03d', role, irun - 1) AS segment_id, printf('%s_L1_%03d_%03d', role, ix, orun - 1) AS parent_id, any_value(l0) AS says, {_ENDS} FROM i GROUP BY {_K}, ix, orun, irun
UNION ALL SELECT 1, {_K}, printf('%s_L1_%03d_%03d', role, ix, orun - 1), printf('%s_L2_%03d', role, ix), any_value(l1), {_ENDS} FROM i GROUP BY {_K}, ix, orun
UNION ALL SELECT 2, i.role, i.l2_segment_id, printf('%s_L2_%03d', i.role, ix), '', (SELECT l2 FROM c WHERE c.role = i.role AND c.l2_segment_id = i.l2_segment_id ORDER BY n DESC, f LIMIT 1), {_ENDS} FROM i GROUP BY i.role, i.l2_segment_id, ix""")
def assemble_nested(spark, d):
    t = A.assemble(_predicted(spark, d))
    pick = lambda level, parent, says, rows: rows.select(F.lit(level).alias("level"), "role", "l2_segment_id", "segment_id", parent.alias("parent_id"), F.col(says).alias("says"), "tp_start", "tp_end", "n_frames", "time_start", "time_end")
    l2_id = F.format_string("%s_L2_%03d", "role", "l2_index")
    return pick(0, F.col("parent_id"), "description", t["l0"]).unionByName(pick(1, l2_id, "summary", t["l1"])).unionByName(pick(2, F.lit(""), "summary", t["l2"]))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, arg_min(event_type, (-n, f)) AS event_type FROM c GROUP BY user_id""")
def majority_per_group(spark, d):
    return A.majority(spark.read.parquet(f"{d}/events.parquet"), ["user_id"], "event_type", "event_id")


_GT = f"""{E}, t AS (SELECT event_id AS id, k % 5 = 0 AS test, ts, 'r' || (user_id % 10) AS role, 's' || (user_id % 3) AS l2_segment_id, event_type AS gt_l0, 'v' || (k % 4) AS gt_l1, 'w' || (k % 2) AS gt_l2 FROM e)"""


def _truth(spark, d):
    rows = events(spark, d)
    return rows.select(F.col("event_id").alias("id"), F.col("event_id").alias("ord"), (F.col("k") % 5 == 0).alias("test"), F.col("ts").alias("tp_id"), F.lit("x").alias("take"), F.concat(F.lit("r"), F.col("user_id") % 10).alias("role"), F.concat(F.lit("s"), F.col("user_id") % 3).alias("l2_segment_id"), F.col("event_type").alias("gt_l0"), F.concat(F.lit("v"), F.col("k") % 4).alias("gt_l1"), F.concat(F.lit("w"), F.col("k") % 2).alias("gt_l2"))


_TOP = "(SELECT {0} FROM t WHERE NOT test GROUP BY {0} ORDER BY count(*) DESC, min(id) LIMIT 1)"


@query(f"WITH {_GT} SELECT id, {', '.join(f'{_TOP.format(f'gt_l{i}')} AS pred_l{i}' for i in range(3))} FROM t WHERE test")
def majority_class(spark, d):
    rows = _truth(spark, d)
    return L.majority_class(rows.where("not test"), rows.where("test")).select("id", "pred_l0", "pred_l1", "pred_l2")


@query(f"WITH {_GT} SELECT id, {', '.join(f"lag(gt_l{i}, 1, '') OVER (PARTITION BY role, l2_segment_id ORDER BY ts, id) AS pred_l{i}" for i in range(3))} FROM t")
def copy_last(spark, d):
    return L.copy_last(_truth(spark, d)).select("id", "pred_l0", "pred_l1", "pred_l2")


_DRAW = """c{0} AS (SELECT gt_l{0} AS label, count(*) AS n, ('0x' || substr(md5(gt_l{0}), 1, 8))::BIGINT % 256 AS part FROM t WHERE NOT test GROUP BY ALL),
s{0} AS (SELECT label, sum(n) OVER (ORDER BY part, label) - n AS a, sum(n) OVER (ORDER BY part, label) AS b, sum(n) OVER () AS total FROM c{0})"""


@query(f"""WITH {_GT}, {", ".join(_DRAW.format(i) for i in range(3))}
SELECT t.id, {", ".join(f"s{i}.label AS pred_l{i}" for i in range(3))} FROM t
{" ".join(f"JOIN s{i} ON ('0x' || substr(md5('42:{i}:' || t.id), 1, 8))::BIGINT % s{i}.total >= s{i}.a AND ('0x' || substr(md5('42:{i}:' || t.id), 1, 8))::BIGINT % s{i}.total < s{i}.b" for i in range(3))} WHERE test""")
def random_baseline(spark, d):
    rows = _truth(spark, d)
    return L.random_label(rows.where("not test"), rows.where("test")).select("id", "pred_l0", "pred_l1", "pred_l2")


# ---------------------------------------------------------------- metrics


@query(f"""WITH {_GT}, c AS (SELECT *, {', '.join(f"lag(gt_l{i}, 1, '') OVER (PARTITION BY role, l2_segment_id ORDER BY ts, id) AS p{i}" for i in range(3))} FROM t)
{" UNION ALL ".join(f"SELECT 'l{i}' AS level, 'exact_match' AS metric, round(avg(CAST(gt_l{i} = p{i} AS INT)), 9) AS value FROM c" for i in range(3))} UNION ALL SELECT 'all', unnest(['matched', 'total_predictions']), CAST(count(*) AS DOUBLE) FROM c""")
def exact_match(spark, d):
    rows = _truth(spark, d)
    pred = L.copy_last(rows).select("id", *(F.concat(F.lit(" "), f"pred_l{i}", F.lit("\n")).alias(f"pred_l{i}") for i in range(3)))
    got = M.evaluate(pred, rows, scorers={"exact_match": M.exact_match})
    return got.select("level", "metric", F.round("value", 9).alias("value"))


_PAIRS = "pairs AS (SELECT doc_id, d.text AS a, b.text AS b FROM documents d JOIN (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS pos, count(*) OVER () AS n FROM benchmark) b ON b.pos = d.doc_id % b.n)"
_TOKENS = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"


@query(f"""WITH {_PAIRS}, w AS (SELECT doc_id, unnest({_TOKENS.format("a")}) AS t, 0 AS s FROM pairs UNION ALL SELECT doc_id, unnest({_TOKENS.format("b")}), 1 FROM pairs),
c AS (SELECT doc_id, t, count(*) FILTER (WHERE s = 0) AS x, count(*) FILTER (WHERE s = 1) AS y FROM w GROUP BY doc_id, t),
g AS (SELECT doc_id, sum(least(x, y)) AS hits, sum(x + y) AS n FROM c GROUP BY doc_id)
SELECT p.doc_id, round(coalesce(2.0 * hits / n, 0.0), 9) AS rouge1 FROM pairs p LEFT JOIN g ON g.doc_id = p.doc_id""")
def rouge1_unstemmed(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("text").alias("a"))
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    # every item in turn, by its place in the order of ids (a benchmark's items are few)
    placed = items.select(F.col("text").alias("b"), (F.row_number().over(Window.orderBy("item_id")) - 1).alias("pos"), F.count("*").over(Window.partitionBy()).alias("n"))
    one = items.agg(F.count("*").alias("n"))
    pairs = docs.join(F.broadcast(one)).withColumn("pos", F.col("doc_id") % F.col("n")).drop("n").join(placed.drop("n"), "pos")
    return M.rouge1_table(pairs, "doc_id", "a", "b").select("doc_id", F.round("rouge1", 9).alias("rouge1"))


_SPLIT = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
_GRAMS = " UNION ALL ".join(f"SELECT conv_id, turn, {side} AS side, {n} AS n, unnest(list_transform(generate_series(1, greatest(len({c}) - {n - 1}, 0)), lambda i: array_to_string({c}[i:i + {n - 1}], chr(31)))) AS g FROM tok" for side, c in ((0, "ra"), (1, "hy")) for n in range(1, 5))


@query(f"""WITH pr AS (SELECT a.conv_id, a.turn, a.text AS a, b.text AS b FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
tok AS (SELECT conv_id, turn, {_SPLIT.format("lower(a)")} AS ra, {_SPLIT.format("lower(b)")} AS hy FROM pr),
g AS ({_GRAMS}), c AS (SELECT conv_id, turn, n, g, count(*) FILTER (WHERE side = 0) AS x, count(*) FILTER (WHERE side = 1) AS y FROM g GROUP BY ALL),
h AS (SELECT conv_id, turn, n, sum(least(x, y)) AS hits, sum(y) AS total FROM c GROUP BY ALL),
m AS (SELECT conv_id, turn, sum(ln((CASE WHEN hits = 0 THEN 0.1 ELSE hits END) / greatest(total, 1)) / 4) AS logs, count(*) AS k, sum(hits) FILTER (WHERE n = 1) AS one FROM h GROUP BY ALL)
SELECT tok.conv_id, tok.turn, CASE WHEN len(ra) = 0 OR len(hy) = 0 OR coalesce(one, 0) = 0 THEN 0.0 ELSE round(exp(logs + (4 - k) * ln(0.1) / 4 + least(0.0, 1 - len(ra) / len(hy))), 6) END AS bleu FROM tok LEFT JOIN m ON m.conv_id = tok.conv_id AND m.turn = tok.turn""")
def bleu(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.round(M.text_scores(F.col("text"), F.col("next"))["bleu"], 6).alias("bleu"))


def _turns(spark, d):
    talk = spark.read.parquet(f"{d}/conversations.parquet")
    return talk.join(talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next")), ["conv_id", "turn"])


def _suffixes(w: str, rules, fits: str) -> str:
    """The first suffix that a word ends in is replaced if what is before it fits."""
    cases = " ".join(f"WHEN ends_with({w}, '{old}') THEN CASE WHEN {fits.format(s=f'left({w}, len({w}) - {len(old)})')} THEN left({w}, len({w}) - {len(old)}) || '{new}' ELSE {w} END" for old, new in rules)
    return f"CASE {cases} ELSE {w} END"


def _stems_sql(source: str) -> str:
    """CTEs that end in `stems` (t, s) for the tokens t of `source`: Porter's steps, a column each."""
    has = lambda pattern: f"regexp_matches({{s}}, '{pattern}')"
    one, two = f"^{N.FIRST_VOWELS}{N.CONSONANTS}", f"^{N.FIRST_VOWELS}{N.CONSONANTS}{N.VOWELS}{N.CONSONANTS}"
    just, consonant = f"^{N.FIRST_VOWELS}{N.CONSONANTS}(?:{N.VOWELS})?$", "(?:[^aeiouy]|^y|[aeiou]y)"
    short = f"(regexp_matches({{s}}, '{consonant}[aeiouy][^aeiouwxy]$') AND len({{s}}) > 2 OR regexp_matches({{s}}, '^[aeiou][^aeiou]$'))"
    cut = lambda w, n: f"left({w}, len({w}) - {n})"
    stage = lambda name, before, body: f"{name} AS (SELECT t, {body} AS w FROM {before})"
    vowel = has(f"^{N.FIRST_VOWELS}")
    past = f"CASE WHEN ends_with(w, 'ed') AND {vowel.format(s=cut('w', 2))} THEN {cut('w', 2)} WHEN ends_with(w, 'ing') AND NOT ends_with(w, 'ed') AND {vowel.format(s=cut('w', 3))} THEN {cut('w', 3)} END"
    restored = f"""CASE WHEN ends_with(p, 'at') OR ends_with(p, 'bl') OR ends_with(p, 'iz') THEN p || 'e'
        WHEN len(p) > 1 AND p[-1] = p[-2] AND p[-1] NOT IN ('a', 'e', 'i', 'o', 'u', 'y') THEN CASE WHEN p[-1] IN ('l', 's', 'z') THEN p ELSE {cut('p', 1)} END
        WHEN {has(just).format(s='p')} AND {short.format(s='p')} THEN p || 'e' ELSE p END"""
    ion = f"CASE WHEN ends_with(w, 'ion') THEN CASE WHEN {has(two).format(s=cut('w', 3))} AND w[-4] IN ('s', 't') THEN {cut('w', 3)} ELSE w END ELSE {_suffixes('w', [(x, '') for x in N.STEP_4 if x != 'ion'], has(two))} END"
    e = cut("w", 1)
    odd = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in N.IRREGULAR.items())
    return ", ".join([
        f"z0 AS (SELECT DISTINCT t, t AS w FROM {source} WHERE len(t) > 3 AND t NOT IN ({', '.join(repr(x) for x in N.IRREGULAR)}))",
        stage("z1", "z0", f"CASE WHEN ends_with(w, 'ies') AND len(w) = 4 THEN {cut('w', 1)} WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut('w', 2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut('w', 1)} ELSE w END"),
        f"z2 AS (SELECT t, w, {past} AS p FROM z1)",
        stage("z3", "z2", f"CASE WHEN ends_with(w, 'ied') THEN CASE WHEN len(w) = 4 THEN {cut('w', 1)} ELSE {cut('w', 2)} END WHEN ends_with(w, 'eed') THEN CASE WHEN {has(one).format(s=cut('w', 3))} THEN {cut('w', 1)} ELSE w END WHEN p IS NULL THEN w ELSE {restored} END"),
        stage("z4", "z3", f"CASE WHEN len(w) > 2 AND regexp_matches(w, '{consonant}y$') THEN {cut('w', 1)} || 'i' ELSE w END"),
        stage("z5", "z4", f"CASE WHEN ends_with(w, 'logi') THEN CASE WHEN {has(one).format(s=cut('w', 3))} THEN {cut('w', 1)} ELSE w END ELSE {_suffixes('w', N.STEP_2, has(one))} END"),
        stage("z6", "z5", _suffixes("w", N.STEP_3, has(one))),
        stage("z7", "z6", ion),
        stage("z8", "z7", f"CASE WHEN ends_with(w, 'e') AND ({has(two).format(s=e)} OR {has(just).format(s=e)} AND NOT {short.format(s=e)}) THEN {e} ELSE w END"),
        stage("z9", "z8", f"CASE WHEN ends_with(w, 'll') AND {has(two).format(s=cut('w', 1))} THEN {cut('w', 1)} ELSE w END"),
        f"stems AS (SELECT t, w AS s FROM z9 UNION ALL SELECT DISTINCT t, CASE t {odd} ELSE t END FROM {source} WHERE NOT (len(t) > 3 AND t NOT IN ({', '.join(repr(x) for x in N.IRREGULAR)})))",
    ])


def _metrics_sql(stemmed: bool) -> str:
    """BLEU as in its own query; unigram overlap by counts; the longest common subsequence row by row, one token of the
    second text at a time (a prefix maximum over the first text's places)."""
    stems = _stems_sql("w") if stemmed else "stems AS (SELECT DISTINCT t, t AS s FROM w)"
    return f"""WITH RECURSIVE pairs AS (SELECT a.conv_id, a.turn, a.text AS a, b.text AS b FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
w AS (SELECT conv_id, turn, 0 AS side, unnest({_TOKENS.format("a")}) AS t, generate_subscripts({_TOKENS.format("a")}, 1) AS i FROM pairs
  UNION ALL SELECT conv_id, turn, 1, unnest({_TOKENS.format("b")}), generate_subscripts({_TOKENS.format("b")}, 1) FROM pairs),
{stems},
x AS MATERIALIZED (SELECT w.conv_id, w.turn, side, i, s FROM w JOIN stems USING (t)),
c AS (SELECT conv_id, turn, s, count(*) FILTER (side = 0) AS p, count(*) FILTER (side = 1) AS q FROM x GROUP BY ALL),
g AS (SELECT conv_id, turn, sum(least(p, q)) AS hits, sum(p + q) AS n FROM c GROUP BY ALL),
y AS MATERIALIZED (SELECT * FROM x WHERE side = 1),
lcs AS (
  SELECT conv_id, turn, 0::BIGINT AS k, i AS j, s, 0::BIGINT AS v FROM x WHERE side = 0
  UNION ALL
  SELECT l.conv_id, l.turn, l.k + 1, l.j, l.s, max(CASE WHEN l.s = y.s THEN pv + 1 ELSE v END) OVER (PARTITION BY l.conv_id, l.turn ORDER BY l.j ROWS UNBOUNDED PRECEDING)
  FROM (SELECT *, coalesce(lag(v) OVER (PARTITION BY conv_id, turn ORDER BY j), 0) AS pv FROM lcs) l JOIN y ON y.conv_id = l.conv_id AND y.turn = l.turn AND y.i = l.k + 1),
f AS (SELECT conv_id, turn, max(v) AS v FROM lcs GROUP BY ALL)
SELECT b.conv_id, b.turn, b.bleu, round(coalesce(2.0 * f.v / n, 0.0), 9) AS rouge_l, round(coalesce(2.0 * hits / n, 0.0), 9) AS rouge1
FROM ({SQL["bleu"].replace("len(hy))), 6)", "len(hy))), 9)")}) b LEFT JOIN g USING (conv_id, turn) LEFT JOIN f USING (conv_id, turn)"""


def _text_metrics(spark, d, stem):
    scored = _turns(spark, d).withColumn("s", M.text_scores(F.col("text"), F.col("next"), stem))
    return scored.select("conv_id", "turn", *(F.round(F.col("s")[m], 9).alias(m.replace("rougeL", "rouge_l")) for m in ("bleu", "rougeL", "rouge1")))


@query(_metrics_sql(False))
def text_metrics(spark, d):
    return _text_metrics(spark, d, None)


@query(_metrics_sql(True))
def text_metrics_stemmed(spark, d):
    return _text_metrics(spark, d, N.token_stem)


@query(f"""WITH w AS (SELECT doc_id, unnest({_TOKENS.format("text")}) AS t FROM documents), {_stems_sql("w")} SELECT s AS stem, count(*) AS n, count(DISTINCT w.t) AS tokens FROM w JOIN stems USING (t) GROUP BY s""")
def stems_of_documents(spark, d):
    """Every token of the documents by stem; each distinct token is stemmed once."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " "), lambda x: x != "")
    counts = spark.read.parquet(f"{d}/documents.parquet").select(F.explode(words).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return N.with_stems(counts, "t").groupBy("stem").agg(F.sum("n").alias("n"), F.count("*").alias("tokens"))
