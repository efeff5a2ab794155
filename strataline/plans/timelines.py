"""Queries over the events table as timelines, and the SQL each is held against.

A user is a role, an event a time point, its type the state; hours and parts of the payload give sets of items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..operators import grouping as G
from ..operators import intervals as J
from ..operators import islands as I
from ..operators import labels as B
from ..operators import timeline as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def events(spark, d: str) -> DataFrame:
    """Events with hour and second since the start of 2024 and the payload's number."""
    rows = spark.read.parquet(f"{d}/events.parquet")
    zero = "timestampdiff({}, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))"
    return rows.withColumn("hour", F.expr(zero.format("HOUR"))).withColumn("sec", F.expr(zero.format("SECOND"))).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


E = """e AS (SELECT *, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS hour, date_diff('second', TIMESTAMP '2024-01-01', ts) AS sec,
  CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""


def runs_sql(source: str, out: str, state: str, keys: str = "user_id", order: str = "ts, event_id", run: str = "run") -> str:
    same = " AND ".join(f"lag({s}) OVER w IS NOT DISTINCT FROM {s}" for s in state.split(", "))
    return f"""{out}_ AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND {same} THEN 0 ELSE 1 END AS brk FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY {order})),
{out} AS (SELECT * EXCLUDE (brk), CAST(sum(brk) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS {run} FROM {out}_)"""


def debounce_sql(source: str, out: str, state: str, keys: str = "user_id", order: str = "ts, event_id", frames: int = 2) -> str:
    """CTEs that end in `out`, with the smoothed state as `sm` and its run."""
    return f"""{runs_sql(source, out + "1", state, keys, order, "raw")},
{out}2 AS (SELECT *, count(*) OVER (PARTITION BY {keys}, raw) AS len, count(*) OVER (PARTITION BY {keys}) AS n FROM {out}1),
{out}3 AS (SELECT *, last_value(CASE WHEN raw = 1 OR len >= {frames} OR n < 3 THEN {state} END IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sm FROM {out}2),
{runs_sql(out + "3", out, "sm", keys, order)}"""


_SEGMENTS = """SELECT user_id, printf('%s_L0_%03d', CAST(user_id AS VARCHAR), run - 1) AS segment_id, arg_min(event_id, (ts, event_id)) AS tp_start, arg_max(event_id, (ts, event_id)) AS tp_end,
  count(*) AS n_frames, any_value({0}) AS state FROM s GROUP BY user_id, run"""


def _l0(spark, d, frames):
    found = I.segments(events(spark, d), "user_id", ["ts", "event_id"], "event_type", frames, tp="event_id")
    return found.select("user_id", T.segment_id(F.col("user_id"), 0, F.col("segment")).alias("segment_id"), "tp_start", "tp_end", "n_frames", F.col("event_type").alias("state"))


@query(f"WITH {debounce_sql('events', 's', 'event_type')} {_SEGMENTS.format('sm')}")
def l0_segments_debounced(spark, d):
    return _l0(spark, d, 2)


@query(f"WITH {runs_sql('events', 's', 'event_type')} {_SEGMENTS.format('event_type')}")
def l0_segments_raw(spark, d):
    return _l0(spark, d, 1)


@query(f"""WITH {debounce_sql("events", "s", "event_type")}
SELECT user_id, max(raw) AS raw, max(run) AS debounced, max(raw) - max(run) AS removed FROM s GROUP BY user_id""")
def debounce_report_per_role(spark, d):
    ev = events(spark, d)
    order = ["ts", "event_id"]
    # one shuffle: both numberings live in the same partitions
    both = I.with_run(I.debounce(I.with_run(ev, "user_id", order, "event_type", "raw"), "user_id", order, "event_type"), "user_id", order, "event_type")
    return both.groupBy("user_id").agg(F.max("raw").alias("raw"), F.max("run").alias("debounced")).withColumn("removed", F.col("raw") - F.col("debounced"))


_ROLES = tuple(f"r{i}" for i in range(7))
_ACTIVE = ("click", "signup", "error", "purchase")


def triplets(spark, d):
    return events(spark, d).select("hour", F.concat(F.lit("r"), F.col("user_id") % 10).alias("subj"), F.col("event_type").alias("pred"), F.concat(F.lit("k"), F.col("k") % 3).alias("obj"))


_TRIPLETS = "t AS (SELECT hour, 'r' || (user_id % 10) AS subj, event_type AS pred, 'k' || (k % 3) AS obj FROM e)"
_state = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["p"], F.lit(":"), x["o"])), ";")


def _roles(spark, d):
    return S.role_timeline(triplets(spark, d), keys=("hour",), roles=_ROLES, active=_ACTIVE)


_ROLE_STATE = """r AS (SELECT hour, subj AS role, coalesce(array_to_string(list_sort(list(DISTINCT pred || ':' || obj) FILTER (WHERE pred <> 'view')), ';'), '') AS state
FROM t WHERE subj IN ('r0','r1','r2','r3','r4','r5','r6') GROUP BY hour, subj)"""


@query(f"WITH {E}, {_TRIPLETS}, {_ROLE_STATE} SELECT * FROM r")
def role_state_timeline(spark, d):
    return _roles(spark, d).select("hour", "role", _state(F.col("state")).alias("state"))


@query(f"""WITH {E}, {_TRIPLETS},
x AS (SELECT hour, obj AS role, CASE WHEN pred <> 'view' THEN pred || ':' || subj END AS item FROM t WHERE obj IN ('k0', 'k1')
  UNION ALL SELECT hour, CASE pred WHEN 'purchase' THEN 'k2' ELSE 'k0' END, pred || ':' || subj FROM t WHERE pred IN ('purchase', 'view'))
SELECT hour, role, coalesce(array_to_string(list_sort(list(DISTINCT item) FILTER (WHERE item IS NOT NULL)), ';'), '') AS state FROM x GROUP BY hour, role""")
def tool_state_timeline(spark, d):
    found = S.tool_timeline(triplets(spark, d), keys=("hour",), tools=("k0", "k1"), active=_ACTIVE, verb_tool={"purchase": "k2", "view": "k0"})
    return found.select("hour", "role", _state(F.col("state")).alias("state"))


@query(f"""WITH {E}, {_TRIPLETS}, {_ROLE_STATE}, {runs_sql("r", "q", "state", "role", "hour")},
l AS (SELECT *, count(*) OVER (PARTITION BY role, run) AS len FROM q),
c AS (SELECT l.state AS cur, coalesce(b.state, '') AS bef, coalesce(a.state, '') AS aft FROM l
  LEFT JOIN r b ON b.role = l.role AND b.hour = l.hour - 1 LEFT JOIN r a ON a.role = l.role AND a.hour = l.hour + 1 WHERE len = 1),
g AS (SELECT CASE WHEN bef = aft THEN 'FLICKER' WHEN cur = '' THEN 'DROPOUT' WHEN bef = '' AND aft <> '' THEN 'PRE_TRANSITION' WHEN aft = '' THEN 'POST_ACTIVITY' ELSE 'UNIQUE' END AS category FROM c)
SELECT category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM g), 1) AS percent FROM g GROUP BY category""")
def debounce_noise_categories(spark, d):
    noise = I.one_row_noise(_roles(spark, d), "role", "hour", "state")
    counts = noise.groupBy("category").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("category", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("percent"))


@query(f"""WITH {E}, x AS (SELECT user_id, event_id, event_type, 'n' || k AS name, CASE WHEN k % 7 = 0 THEN 0.0 ELSE value END AS c FROM e)
SELECT user_id, arg_min(name, (-c, event_id)) FILTER (WHERE event_type = 'click') AS phase, arg_min(name, (-c, event_id)) FILTER (WHERE event_type = 'purchase') AS step
FROM x WHERE event_type IN ('click', 'purchase') AND c > -1 GROUP BY user_id""")
def screen_argmax_first_tie(spark, d):
    kind = F.when(F.col("event_type") == "click", "phase").when(F.col("event_type") == "purchase", "current_step").otherwise("other")
    sure = F.when(F.col("k") % 7 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return S.screen_choice(events(spark, d).select("user_id", "event_id", F.concat(F.lit("n"), "k").alias("name"), kind.alias("type"), sure.alias("certainty")), ["user_id"], ["event_id"])


_ENTITIES = ("head_surgeon", "nurse", "c_arm", "some_other_thing", "saw")
_PREDICATES = {"click": "Touching", "view": "CloseTo", "purchase": "Holding", "error": "Sawing", "signup": "Whatever"}
_case = lambda key, table, other: f"CASE {key} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + f" ELSE {other} END"


@query(f"""WITH x AS (SELECT event_id, ['head_surgeon', 'nurse', 'c_arm', 'some_other_thing', 'saw'][user_id % 5 + 1] AS role,
  ['head_surgeon', 'nurse', 'c_arm', 'some_other_thing', 'saw'][event_id % 5 + 1] AS obj, {_case("event_type", _PREDICATES, "''")} AS pred FROM events),
h AS (SELECT event_id, {_case("role", V.ENTITY_NAMES, "replace(role, '_', ' ')")} AS r, {_case("obj", V.ENTITY_NAMES, "replace(obj, '_', ' ')")} AS o, {_case("pred", V.PREDICATE_NAMES, "pred")} AS p FROM x)
SELECT event_id, r || ': ' || p || ' ' || o AS person, r || ': ' || o || ' ' || p AS tool, r || ': ' || CASE WHEN event_id % 3 = 0 THEN 'idle' WHEN event_id % 3 = 1 THEN 'A' ELSE 'A (B)' END AS robot FROM h""")
def humanized_descriptions(spark, d):
    entity = F.array(*map(F.lit, _ENTITIES))
    pick = lambda c: F.element_at(entity, (F.col(c) % 5 + 1).cast("int"))
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", pick("user_id").alias("role"), F.array(F.struct(V.lookup(F.col("event_type"), _PREDICATES).alias("p"), pick("event_id").alias("o"))).alias("state"))
    m = F.col("event_id") % 3
    robot = S.robot_state(F.when(m > 0, F.lit("A")).otherwise(""), F.when(m == 2, F.lit("B")))
    return rows.select("event_id", T.describe_role(F.col("role"), F.col("state")).alias("person"), T.describe_tool(F.col("role"), F.col("state")).alias("tool"), T.describe_robot(F.col("role"), robot).alias("robot"))


@query(f"""WITH {E}, x AS (SELECT user_id, event_id, sec, event_type, k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord FROM e)
SELECT user_id, ord, CAST(sec % 86400 * 1000 + k AS BIGINT) AS start_ms, CAST((sec % 86400 + 5) * 1000 AS BIGINT) AS end_ms, event_type || ' ' || k AS text FROM x WHERE k % 11 <> 0""")
def srt_roundtrip(spark, d):
    s = F.col("sec") % 86400
    clock = lambda x, ms: F.format_string("%02d:%02d:%02d,%03d", F.floor(x / 3600), F.floor(x / 60) % 60, x % 60, ms)
    stamp = F.when(F.col("k") % 11 == 0, "no time").otherwise(F.concat(clock(s, F.col("k")), F.lit(" --> "), clock(s + 5, F.lit(0))))
    block = F.concat(F.col("event_id").cast("string"), F.lit("\n"), stamp, F.lit("\n"), F.col("event_type"), F.lit("\n"), F.col("k").cast("string"))
    files = events(spark, d).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("srt"))
    from ..sources.recordings import parse_srt

    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return parse_srt(files, "srt", ["user_id"]).select("user_id", F.col("ord").cast("long").alias("ord"), ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), "text")


_TIMED = f"{debounce_sql('e', 's', 'event_type')}, g AS (SELECT user_id, run - 1 AS segment, any_value(sm) AS state, min(sec) AS a, max(sec) AS b FROM s GROUP BY user_id, run)"


def _timed(spark, d):
    found = I.segments(events(spark, d), "user_id", ["ts", "event_id"], "event_type", 2, tp="event_id", extra={"a": F.min("sec"), "b": F.max("sec")})
    return found.select("user_id", "segment", F.col("event_type").alias("state"), "a", "b")


@query(f"""WITH {E}, {_TIMED}, t AS (SELECT user_id, event_id, sec AS x, sec + k * 600 AS y FROM e WHERE event_type = 'view')
SELECT g.user_id, segment, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS heard, count(*) AS n FROM g JOIN t ON t.user_id = g.user_id AND t.y >= g.a AND t.x <= g.b GROUP BY g.user_id, segment""")
def transcript_overlap_join(spark, d):
    said = events(spark, d).where("event_type = 'view'").select("user_id", F.col("event_id").alias("ord"), F.col("sec").alias("start_s"), (F.col("sec") + F.col("k") * 600).alias("end_s"), F.col("event_id").cast("string").alias("text"))
    got = J.overlap_lists(_timed(spark, d), said, ["user_id"], "segment", ("a", "b"))
    return got.select("user_id", "segment", F.array_join(F.transform("transcript", lambda x: x["text"]), ",").alias("heard"), F.size("transcript").cast("long").alias("n"))


@query(f"""WITH {E}, {_TIMED} SELECT event_id, (SELECT arg_min(state, segment) FROM g WHERE g.user_id = e.user_id AND e.sec BETWEEN a AND b) AS state FROM e""")
def label_at_time(spark, d):
    points = events(spark, d).select("event_id", "user_id", "sec")
    return J.label_points(points, _timed(spark, d), ["user_id"], "sec", ("a", "b"), "state", "segment").select("event_id", "state")


@query(f"""WITH {E}, q AS (SELECT event_id, user_id, sec FROM e WHERE event_type = 'click'), v AS (SELECT DISTINCT user_id, sec FROM e WHERE event_type = 'purchase'),
j AS (SELECT event_id, q.sec, (SELECT max(v.sec) FROM v WHERE v.user_id = q.user_id AND v.sec <= q.sec) AS previous, (SELECT min(v.sec) FROM v WHERE v.user_id = q.user_id AND v.sec >= q.sec) AS following FROM q)
SELECT event_id, previous, following, CASE WHEN previous IS NULL THEN following WHEN following IS NULL THEN previous WHEN following - sec < sec - previous THEN following ELSE previous END AS nearest FROM j""")
def nearest_valid_time(spark, d):
    ev = events(spark, d).select("event_id", "event_type", "user_id", "sec")
    return J.as_of(ev.where("event_type = 'click'").drop("event_type"), ev.where("event_type = 'purchase'"), ["user_id"], "sec", "sec").select("event_id", "previous", "following", "nearest")


def _steps(spark, d):
    """Hours of each role cut into segments, steps of three segments and phases of two steps."""
    seg = I.segments(_roles(spark, d), "role", ["hour"], "state", 2).withColumn("children", F.lit(None).cast("array<string>"))
    ident = lambda level, n: T.segment_id(F.col("role"), level, n)
    l0 = seg.select("role", ident(0, F.col("segment")).alias("segment_id"), F.col("segment").alias("ord"), "tp_start", "tp_end", _state(F.col("state")).alias("description"), F.floor(F.col("segment") / 3).alias("up"))
    up = lambda t, level, n: t.groupBy("role", F.col("up").alias("ord")).agg(F.array_sort(F.collect_list("segment_id")).alias("children")).select("role", ident(level, F.col("ord")).alias("segment_id"), "ord", "children", F.concat(F.lit(f"s{level}-"), "ord").alias("summary"), F.floor(F.col("ord") / n).alias("up"))
    l1 = up(l0, 1, 2)
    return l0, l1, up(l1, 2, 1)


_STEPS = f"{_TRIPLETS}, {_ROLE_STATE}, {debounce_sql('r', 's', 'state', 'role', 'hour')}, g AS (SELECT role, run - 1 AS i, min(hour) AS a, max(hour) AS b, any_value(sm) AS state FROM s GROUP BY role, run)"


@query(f"""WITH {E}, {_STEPS}
SELECT role, tp, printf('%s_L0_%03d', role, i) AS l0_id, state AS l0, printf('%s_L1_%03d', role, i // 3) AS l1_id, printf('%s_L2_%03d', role, i // 6) AS l2_id, 's2-' || (i // 6) AS l2
FROM (SELECT *, unnest(generate_series(a, b)) AS tp FROM g)""")
def frame_labels_expand(spark, d):
    return B.frame_labels(*_steps(spark, d), ["role"]).select("role", "tp", "l0_id", "l0", "l1_id", "l2_id", "l2")


@query(f"""WITH {E}, {_STEPS} SELECT role, printf('%s_L2_%03d', role, i // 6) AS l2_id, count(DISTINCT tp) AS n FROM (SELECT *, unnest(generate_series(a, b)) AS tp FROM g) GROUP BY 1, 2""")
def l2_time_points(spark, d):
    return B.time_points(*_steps(spark, d), ["role"]).groupBy("role", "l2_id").agg(F.count("*").alias("n"))


@query(f"""WITH {E}, {_STEPS}, k AS (SELECT * FROM g WHERE i % 4 <> 1)
SELECT role, printf('%s_L1_%03d', role, i // 3) AS segment_id, string_agg(printf('%s_L0_%03d', role, i), ',' ORDER BY i) AS children FROM k GROUP BY role, i // 3""")
def untimed_segments_dropped(spark, d):
    l0, l1, l2 = _steps(spark, d)
    timed = l0.withColumn("time_start", F.when(F.col("ord") % 4 != 1, F.col("tp_start"))).withColumn("time_end", F.col("tp_end"))
    _, kept, _ = B.drop_untimed(timed, l1, l2, ["role"])
    return kept.select("role", "segment_id", F.array_join("children", ",").alias("children"))


@query(f"""WITH {E} SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 7 AS win, event_id FROM e""")
def tumbling_count_windows(spark, d):
    return I.count_windows(events(spark, d), "user_id", ["ts", "event_id"], 7).select("user_id", F.col("window").alias("win"), "event_id")


@query("""WITH x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
c AS (SELECT *, unnest(generate_series(0, CAST(greatest(0, ceil((n - 30) / 27)) AS BIGINT))) AS chunk FROM x)
SELECT user_id, chunk, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM c WHERE pos >= chunk * 27 AND pos < chunk * 27 + 30 GROUP BY user_id, chunk""")
def overlapping_chunks(spark, d):
    rows = I.overlapping_chunks(events(spark, d), "user_id", ["ts", "event_id"])
    return rows.groupBy("user_id", "chunk").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query("""SELECT event_id FROM events WHERE (event_type, user_id) IN (SELECT DISTINCT event_type, user_id FROM events ORDER BY event_type, user_id LIMIT 37)""")
def filter_groups_topn(spark, d):
    return G.first_groups(events(spark, d), ["event_type", "user_id"], 37).select("event_id")


@query(f"""WITH {E}, x AS (SELECT *, k % 13 <> 0 AS done FROM e) SELECT event_id FROM x WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM x GROUP BY ALL HAVING bool_and(done))""")
def resume_incomplete_groups(spark, d):
    ev = events(spark, d).select(F.col("event_id").alias("id"), "user_id", "event_type", "k")
    return G.incomplete_groups(ev, ev.where("k % 13 <> 0"), ["user_id", "event_type"]).select(F.col("id").alias("event_id"))


@query(f"""WITH {E}, x AS (SELECT user_id, event_id, k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM e),
m AS (SELECT user_id, list(CAST(event_id AS VARCHAR) ORDER BY event_id) AS ids, coalesce(list(CAST(event_id AS VARCHAR) ORDER BY event_id) FILTER (WHERE k % 29 <> 0), []) AS seen FROM x GROUP BY user_id)
SELECT user_id, 'missing segments' AS issue, array_to_string(list_sort(list_filter(ids, lambda i: NOT list_contains(seen, i))), ',') AS detail FROM m WHERE len(seen) < len(ids)
UNION ALL SELECT user_id, 'empty group', '' FROM x GROUP BY user_id, pos // 5 HAVING count(*) FILTER (WHERE k % 29 <> 0) = 0
UNION ALL SELECT user_id, 'missing summary', CAST(max(event_id) FILTER (WHERE k % 29 <> 0) AS VARCHAR) FROM x WHERE (pos // 5) % 4 = 0 GROUP BY user_id, pos // 5 HAVING count(*) FILTER (WHERE k % 29 <> 0) > 0""")
def group_validation_issues(spark, d):
    ev = I.count_windows(events(spark, d), "user_id", ["event_id"], 5)
    ids = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x.cast("string"))
    groups = ev.groupBy("user_id", F.col("window").alias("ord")).agg(ids(F.when(F.col("k") % 29 != 0, F.col("event_id"))).alias("segment_ids")).withColumn("summary", F.when(F.col("ord") % 4 == 0, "").otherwise("says"))
    return G.validate_groups(groups, ev.groupBy("user_id").agg(ids(F.col("event_id")).alias("ids")), ["user_id"])


@query(f"""WITH RECURSIVE {E}, {_STEPS}, nx AS (SELECT role, i, a, b, state, lead(state) OVER (PARTITION BY role ORDER BY i) AS nxt, count(*) OVER (PARTITION BY role) AS n FROM g),
fo AS (SELECT role, i, a, b, CAST(0 AS BIGINT) AS grp, state AS says, state = '' AND n > 1 AS opens, false AS eats FROM nx WHERE i = 0
  UNION ALL SELECT nx.role, nx.i, nx.a, nx.b, CASE WHEN fo.eats OR fo.opens OR nx.state = '' THEN fo.grp ELSE fo.grp + 1 END, CASE WHEN fo.opens THEN nx.state WHEN fo.eats OR nx.state = '' THEN fo.says ELSE nx.state END, false,
    NOT fo.eats AND NOT fo.opens AND nx.state = '' AND coalesce(nx.nxt, '') <> '' AND nx.nxt = fo.says FROM fo JOIN nx ON nx.role = fo.role AND nx.i = fo.i + 1)
SELECT role, grp AS ord, string_agg(printf('%s_L0_%03d', role, i), ',' ORDER BY i) AS segment_ids, CAST(min(a) AS BIGINT) AS time_start, CAST(max(b) AS BIGINT) AS time_end, arg_max(says, i) AS summary, '' AS audio_summary FROM fo GROUP BY role, grp""")
def collapse_idle_l1(spark, d):
    return _folded(spark, d, F.lit(""))


def _folded(spark, d, audio):
    seg = I.segments(_roles(spark, d), "role", ["hour"], "state", 2)
    ids = T.segment_id(F.col("role"), 0, F.col("segment"))
    step = seg.select("role", F.col("segment").cast("int").alias("ord"), F.array(ids).alias("segment_ids"), F.when(T.is_idle(F.col("state")), F.array(ids)).otherwise(F.array().cast("array<string>")).alias("idle_ids"), F.col("tp_start").cast("int").alias("time_start"), F.col("tp_end").cast("int").alias("time_end"), _state(F.col("state")).alias("summary"), audio.alias("audio_summary"))
    long = lambda c: F.col(c).cast("long").alias(c)
    return G.fold_idle_steps(step, ["role"]).select("role", long("ord"), F.array_join("segment_ids", ",").alias("segment_ids"), long("time_start"), long("time_end"), "summary", "audio_summary")


@query(f"""WITH RECURSIVE {E}, {_STEPS}, nx AS (SELECT role, i, a, b, state, lead(state) OVER (PARTITION BY role ORDER BY i) AS nxt, count(*) OVER (PARTITION BY role) AS n FROM g),
fo AS (SELECT role, i, a, b, CAST(0 AS BIGINT) AS grp, state AS says, state = '' AND n > 1 AS opens, false AS eats FROM nx WHERE i = 0
  UNION ALL SELECT nx.role, nx.i, nx.a, nx.b, CASE WHEN fo.eats OR fo.opens OR nx.state = '' THEN fo.grp ELSE fo.grp + 1 END, CASE WHEN fo.opens THEN nx.state WHEN fo.eats OR nx.state = '' THEN fo.says ELSE nx.state END, false,
    NOT fo.eats AND NOT fo.opens AND nx.state = '' AND coalesce(nx.nxt, '') <> '' AND nx.nxt = fo.says FROM fo JOIN nx ON nx.role = fo.role AND nx.i = fo.i + 1)
SELECT role, grp AS ord, string_agg(printf('%s_L0_%03d', role, i), ',' ORDER BY i) AS segment_ids, CAST(min(a) AS BIGINT) AS time_start, CAST(max(b) AS BIGINT) AS time_end, arg_max(says, i) AS summary, coalesce(string_agg('a' || i, '; ' ORDER BY i) FILTER (WHERE i % 3 = 1), '') AS audio_summary FROM fo GROUP BY role, grp""")
def audio_of_folded_steps(spark, d):
    """As collapse_idle_l1, with what was heard in every third segment."""
    return _folded(spark, d, F.when(F.col("segment") % 3 == 1, F.concat(F.lit("a"), "segment")).otherwise(""))
