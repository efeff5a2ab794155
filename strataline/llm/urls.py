"""URL filters: pattern rules indexed by their rarest literal token.

A pattern rule is text matched anywhere in the lower-cased url: `*` stands for any characters, `^` for one character
that is not `[a-z0-9]` or for the start or end, a leading `||` for the start of the host or of
one of its labels, a leading or trailing `|` for the start or end of the url. Everything else is literal. The literal
tokens of a rule are its runs of `[a-z0-9]` that no match can lengthen; every rule needs one (else it is kept in a list
that each url runs). Token frequencies are counted over all urls; each rule is filed under its rarest token. A url's
tokens fetch candidate rules, and only those run their regular expression.

Host rules (`host`, `path prefix`, allow or block) fit a host and its subdomains if the url's path starts with the rule's
path; the longest rule wins (host and path together; of equals, the first given). A host rule overrides pattern rules.

Defined results: a null url, or one without `://`, has empty host and path and no tokens of its own, so it is allowed
unless a pattern rule matches its text; repeated rows give repeated results; an empty table gives no rows; null ids stay
null; columns beyond id and url are not read.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (verdict, host, path prefix).
HOST_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def read_rules(path: str | Path) -> tuple[str, ...]:
    """The pattern rules of a file: one a line, without comments and empty lines."""
    lines = (line.strip() for line in Path(path).read_text(encoding="utf-8").splitlines())
    return tuple(dict.fromkeys(line for line in lines if line and not line.startswith("#")))


#: Pattern rules in production: gambling, adult, advertising, tracking, shops, download traps and attacks.
PATTERN_RULES = read_rules(Path(__file__).with_name("url_rules.txt"))
#: Most rules whose tokens are broadcast and whose index is a literal in the plan; more are joined by token.
LITERAL_RULES = 2_000


def to_regex(rule: str) -> str:
    """A pattern rule as a regular expression that Java and RE2 read alike."""
    body, head, tail = rule.lower(), "", ""
    if body.startswith("||"):
        head, body = r"^[^:]*://([^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        tail, body = "$", body[:-1]
    parts = {"*": ".*", "^": r"([^a-z0-9]|$)"}
    mid = "".join(parts.get(c, re.escape(c)) for c in body)
    if body.startswith("^"):
        mid = r"(^|[^a-z0-9])" + mid[len(parts["^"]) :]
    return head + mid + tail


def tokens_of(rule: str) -> list[str]:
    """Literal tokens that stand whole in every url the rule matches."""
    body = rule.lower()
    out = []
    for m in re.finditer(r"[a-z0-9]+", body):
        left = body[m.start() - 1] if m.start() else ""
        right = body[m.end()] if m.end() < len(body) else ""
        if left not in ("", "*") and right not in ("", "*"):
            out.append(m.group())
    return sorted(set(out))


def host_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _host_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Name and verdict of the longest host rule that fits."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]) - len(rules[i][2]), i))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i in reversed(order):
        v, h, p = rules[i]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(url), "[^a-z0-9]+"), lambda t: t != ""))


def rule_index(urls: DataFrame, patterns=PATTERN_RULES) -> tuple[dict[str, list[str]], list[str]]:
    """Regexes of the rules filed under each token: a rule's rarest literal token in `urls`; and the regexes of rules without one.

    The rules are a list of the caller's; what comes back to the driver has a row per rule.
    """
    spark = urls.sparkSession
    pairs = [(t, r) for r in dict.fromkeys(patterns) for t in tokens_of(r)]
    without = [to_regex(r) for r in dict.fromkeys(patterns) if not tokens_of(r)]
    if not pairs:
        return {}, without
    wanted = spark.createDataFrame(pairs, "token string, rule string")
    asked = wanted.select("token").distinct()
    seen = urls.select(F.explode(_tokens(F.col("url"))).alias("token")).join(F.broadcast(asked) if len(pairs) <= LITERAL_RULES else asked, "token", "left_semi").groupBy("token").count()
    best = wanted.join(seen, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "token"))["token"].alias("token"))
    index: dict[str, list[str]] = {}
    for rule, token in sorted(best.collect()):  # one row per rule
        index.setdefault(token, []).append(to_regex(rule))
    return index, without


def filter_urls(pages: DataFrame, host_rules=HOST_RULES, patterns=PATTERN_RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and how many candidate rules ran (n_candidates)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"))
    index, without = rule_index(rows, patterns)
    none = F.array().cast("array<string>")
    if not index:
        found = rows.withColumn("candidates", none)
    elif len(patterns) <= LITERAL_RULES:
        table = F.create_map(*(x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*map(F.lit, rs)))))
        fetched = F.flatten(F.filter(F.transform(_tokens(F.col("url")), lambda t: table[t]), lambda r: r.isNotNull()))
        found = rows.withColumn("candidates", F.coalesce(fetched, none))
    else:
        by_token = rows.sparkSession.createDataFrame(sorted(index.items()), "token string, regexes array<string>")
        got = (
            rows.select("url").distinct().withColumn("token", F.explode(_tokens(F.col("url")))).join(by_token, "token")
            .groupBy("url").agg(F.flatten(F.collect_list("regexes")).alias("candidates"))
        )
        found = rows.join(got, "url", "left").withColumn("candidates", F.coalesce("candidates", none))
    hit = F.exists("candidates", lambda r: F.expr("false") | F.regexp_like(F.lower("url"), r))
    for r in without:
        hit = hit | F.lower("url").rlike(r)
    staged = found.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce(hit, F.lit(False)).alias("hit"), F.size("candidates").cast("long").alias("n_candidates"))
    name, verdict = _host_rule(F.col("host"), F.col("path"), host_rules)
    return staged.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"), "n_candidates")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).drop("n_candidates")


def _sql_case(column: int) -> str:
    order = sorted(range(len(HOST_RULES)), key=lambda i: (-len(HOST_RULES[i][1]) - len(HOST_RULES[i][2]), i))
    value = lambda i: HOST_RULES[i][1] + HOST_RULES[i][2] if column else HOST_RULES[i][0]
    fits = lambda i: f"(host = '{HOST_RULES[i][1]}' OR ends_with(host, '.{HOST_RULES[i][1]}')) AND starts_with(path, '{HOST_RULES[i][2]}')"
    return "CASE " + " ".join(f"WHEN {fits(i)} THEN '{value(i)}'" for i in order) + " END"


_ANY = "|".join(f"({to_regex(r)})" for r in PATTERN_RULES).replace("'", "''")
ORACLE_SQL = f"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
b AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, host, path, {_sql_case(1)} AS rule,
  coalesce({_sql_case(0)}, CASE WHEN regexp_matches(lower(url), '{_ANY}') THEN 'block' ELSE 'allow' END) AS verdict
FROM b
"""
