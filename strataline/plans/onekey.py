"""Queries over all events as one key, which one task could not hold at scale, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hotkeys as H
from ..operators import intervals as J
from ..operators.memory import SHORT_TERM
from .timelines import E, debounce_sql, events, runs_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
_ORDER = ["ts", "event_id"]


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


@query(f"""WITH {debounce_sql("events", "s", "event_type", "true", frames=3)}
SELECT run - 1 AS segment, arg_min(event_id, (ts, event_id)) AS tp_start, arg_max(event_id, (ts, event_id)) AS tp_end, count(*) AS n_frames, any_value(sm) AS state FROM s GROUP BY run""")
def one_key_segments(spark, d):
    return H.spread_segments(events(spark, d), [], _ORDER, "event_type", 3, tp="event_id").withColumnRenamed("event_type", "state")


@query(f"""WITH {runs_sql("events", "a", "user_id % 3", "true", run="outer_run")}, {runs_sql("a", "b", "user_id % 3, event_type", "true", run="inner_run")}
SELECT event_id, outer_run, inner_run, (row_number() OVER (ORDER BY ts, event_id) - 1) // 100 AS win FROM b""")
def one_key_nested_runs(spark, d):
    rows = events(spark, d).select("ts", "event_id", (F.col("user_id") % 3).alias("outer"), "event_type")
    nested = H.nested_segments(rows, [], _ORDER, "outer", "event_type")
    return H.count_windows(nested, [], _ORDER, 100).select("event_id", "outer_run", "inner_run", F.col("window").alias("win"))


@query(f"""WITH {E}, q AS (SELECT event_id, sec FROM e WHERE event_type = 'click'), v AS (SELECT DISTINCT sec FROM e WHERE event_type = 'purchase'),
j AS (SELECT event_id, q.sec, p.sec AS previous, f.sec AS following FROM q ASOF LEFT JOIN v p ON q.sec >= p.sec ASOF LEFT JOIN v f ON q.sec <= f.sec)
SELECT event_id, previous, following, CASE WHEN previous IS NULL THEN following WHEN following IS NULL THEN previous WHEN following - sec < sec - previous THEN following ELSE previous END AS nearest FROM j""")
def one_key_nearest_time(spark, d):
    ev = events(spark, d).select("event_id", "event_type", "sec")
    return H.as_of(ev.where("event_type = 'click'").drop("event_type"), ev.where("event_type = 'purchase'"), [], "sec", "sec").select("event_id", "previous", "following", "nearest")


@query("SELECT event_id, lag(event_type, 1, '') OVER (ORDER BY ts, event_id) AS last_type, lag('u' || user_id, 1, '') OVER (ORDER BY ts, event_id) AS last_user FROM events")
def one_key_copy_last(spark, d):
    rows = events(spark, d).select("ts", "event_id", "event_type", F.concat(F.lit("u"), "user_id").alias("user"))
    return H.copy_last(rows, [], _ORDER, {"last_type": "event_type", "last_user": "user"}).select("event_id", "last_type", "last_user")


@query(f"""WITH {E}, f AS (SELECT event_id, event_type AS l0, CASE k % 3 WHEN 0 THEN '' ELSE 'p' || (k % 3) END AS l1, row_number() OVER (ORDER BY ts, event_id) AS pos FROM e),
v AS (SELECT *, CASE WHEN pos = 1 THEN list_concat(CASE WHEN l1 <> '' THEN ['+L1:' || l1] ELSE [] END, ['+L0:' || l0])
  ELSE list_concat(CASE WHEN l1 <> lag(l1) OVER w THEN ['-L1:' || lag(l1) OVER w, '+L1:' || l1] ELSE [] END, CASE WHEN l0 <> lag(l0) OVER w THEN ['-L0:' || lag(l0) OVER w, '+L0:' || l0] ELSE [] END) END AS ev
  FROM f WINDOW w AS (ORDER BY pos)),
c AS (SELECT *, coalesce(sum(len(ev)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v),
x AS (SELECT pos, unnest(ev) AS item, before + generate_subscripts(ev, 1) AS i FROM c),
g AS (SELECT item[2:] AS key, min(i) AS i, min(pos) AS pos FROM x WHERE item[1] = '+' GROUP BY 1),
s AS (SELECT c.event_id, string_agg(item, '; ' ORDER BY i) AS short FROM c JOIN x ON x.i > c.before - {SHORT_TERM} AND x.i <= c.before GROUP BY c.event_id),
l AS (SELECT c.event_id, string_agg(key, '; ' ORDER BY i) AS long FROM c JOIN g ON g.pos < c.pos GROUP BY c.event_id)
SELECT c.event_id, coalesce(long, '') AS long_term, coalesce(short, '') AS short_term FROM c LEFT JOIN s USING (event_id) LEFT JOIN l USING (event_id)""")
def one_key_memory(spark, d):
    part = F.col("k") % 3
    frames = events(spark, d).select("event_id", "ts", F.col("event_type").alias("l0"), F.when(part == 0, "").otherwise(F.concat(F.lit("p"), part)).alias("l1"))
    return H.with_memory(frames, [], _ORDER).select("event_id", F.array_join("long_term", "; ").alias("long_term"), F.array_join("short_term", "; ").alias("short_term"))


# ---------------------------------------------------------------- intervals whose lengths span five orders of magnitude

_SPANS = """s AS (SELECT event_id, user_id % 5 AS g, sec AS a, sec + CASE k % 6 WHEN 0 THEN 0 WHEN 1 THEN 9 WHEN 2 THEN 100 WHEN 3 THEN 1500 WHEN 4 THEN 20000 ELSE 400000 END AS b FROM e WHERE event_type IN ('signup', 'error'))"""


def _spans(spark, d):
    length = F.element_at(F.array(*map(F.lit, (0, 9, 100, 1500, 20000, 400000))), (F.col("k") % 6 + 1).cast("int"))
    return events(spark, d).where("event_type in ('signup', 'error')").select("event_id", (F.col("user_id") % 5).alias("g"), F.col("sec").alias("a"), (F.col("sec") + length).alias("b"))


@query(f"""WITH {E}, {_SPANS}, t AS (SELECT * FROM s WHERE event_id % 3 = 0), u AS (SELECT * FROM s WHERE event_id % 3 = 1)
SELECT t.event_id, count(*) AS n, min(u.event_id) AS first_id, sum(least(t.b, u.b) - greatest(t.a, u.a)) AS shared FROM t JOIN u ON u.g = t.g AND u.b >= t.a AND u.a <= t.b GROUP BY t.event_id""")
def overlaps_of_all_lengths(spark, d):
    rows = _spans(spark, d)
    other = rows.where("event_id % 3 = 1").select("g", F.col("event_id").alias("other"), F.col("a").alias("c"), F.col("b").alias("d"))
    return J.overlap_summary(rows.where("event_id % 3 = 0"), other, ["g"], ("a", "b"), ("c", "d"), "event_id", "other").select("event_id", "n", F.col("first").alias("first_id"), "shared")


@query(f"""WITH {E}, {_SPANS}, p AS (SELECT event_id, user_id % 5 AS g, sec FROM e WHERE event_type = 'click')
SELECT p.event_id, (SELECT min(s.event_id) FROM s WHERE s.g = p.g AND p.sec BETWEEN s.a AND s.b) AS first_id FROM p""")
def points_in_spans_of_all_lengths(spark, d):
    points = events(spark, d).where("event_type = 'click'").select("event_id", (F.col("user_id") % 5).alias("g"), "sec")
    spans = _spans(spark, d).select("g", "a", "b", F.col("event_id").alias("first_id"))
    return J.label_points(points, spans, ["g"], "sec", ("a", "b"), "first_id", "first_id").select("event_id", "first_id")
