"""Repair of conversation structure: the cheapest edits that give every conversation legal turns.

A conversation is legal if the initials of its roles match `(s?(ua)+)?`. Rows have a first fault: blank, duplicate (role and
text stood earlier in the conversation), truncated (no closing mark at the end). A row may be kept (0), given the role user or
assistant (3), or deleted (4, as blank and duplicate rows must be); an empty turn of either may be inserted anywhere (3);
a truncated row that stays adds 3. The edits of least cost, and of these the ASCII-least string of initials, are found by A*
on the lattice (rows done, last role): the heuristic is a suffix sum of the deletions that must come and of 3 for each
truncated row to come, which no path avoids; the queue is keyed by (cost plus heuristic, edits so far).

On Spark the damaged or given rows are ranked over range partitions; earlier equal rows are found by grouping digests. Ranks
are cut into blocks of SEGMENT rows; a conversation within a block is solved at once. Of one that a block cuts, each segment is
solved from every state it may start in to every state it may end in, and the segments' tables are chained, so no task holds
more of a conversation than a byte per row, a few times over. Edits then meet the rows, sorted, in one more shuffle; texts go
past one by one.

Defined results: a null role or text is one space, in a null turn too; null turns come first; rows of equal turns follow role,
the first 64 characters of text, then a digest of both; a null id is a conversation of its own; a role without a first character
fits no place; an empty table gives no rows; columns beyond the four are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import rank_all
from ..session import ship_package
from . import common as C

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows that one search covers.
SEGMENT = 1024
#: Searches whose outcome a task remembers; conversations of a few turns are alike in structure.
REMEMBERED = 50_000
#: Characters that count as white space.
BLANK = " \t\n\x0b\x0c\r"
#: Last role: none, a leading system turn, user, assistant. What may be emitted where, and what an insertion or new role gives.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FORCED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ACCEPTED = (START, ASSISTANT)
WORD = {USER: "user", ASSISTANT: "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")


def search(initials: str, faults: str, entry: int = START, targets=ACCEPTED, each: bool = False) -> dict[int, tuple[int, str]]:
    """A* from `entry` before the first row to the targets after the last: {state: (cost, edits)} of the best, or of each.

    faults has a letter per row: b blank, d duplicate, t truncated, else none.
    """
    n = len(initials)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if faults[i] in "bd" else TRUNCATED if faults[i] == "t" else 0)
    queue, closed, found = [(ahead[0], "", 0, entry, 0)], set(), {}
    while queue:
        _, edits, i, state, cost = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == n and state in targets:
            found[state] = (cost, edits)
            if not each or len(found) == len(targets):
                break
        forced = FORCED[state]
        moves = [(0, INSERT, "I", forced)]
        if i < n:
            moves.append((1, DELETE, "D", state))
            if faults[i] not in "bd":
                charge = TRUNCATED if faults[i] == "t" else 0
                moves.append((1, REROLE + charge, "R", forced))
                if (state, initials[i]) in NEXT:
                    moves.append((1, charge, "K", NEXT[state, initials[i]]))
        for step, price, edit, after in moves:
            if (i + step, after) not in closed:
                heapq.heappush(queue, (cost + price + ahead[i + step], edits + edit, i + step, after, cost + price))
    return found


# ---------------------------------------------------------------- rows and their faults


def _clean(rows: DataFrame) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))


def ranked(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Rows in a written table with their place `rank` in the whole, by conversation and turn, and block `seg`."""
    known = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    digest = F.unhex(F.sha2(F.concat(known, F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    keyed = _clean(rows).withColumn("digest", digest).withColumn("uid", F.monotonically_increasing_id())
    out = rank_all(keyed, ["conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64), "digest", "uid"]).drop("uid")
    return out.withColumn("seg", F.floor(F.col("rank") / size).cast("long"))


def with_faults(table: DataFrame) -> DataFrame:
    """conv_id, turn, rank, seg of ranked rows, `initial` (s, u, a or -) and `fault` (b, d, t or .)."""
    end = F.rtrim("text", F.lit(BLANK))
    first = F.substring("role", 1, 1)
    rows = table.select(
        "conv_id", "turn", "rank", "seg", "digest",
        F.when(first.isin("s", "u", "a"), first).otherwise("-").alias("initial"),
        F.when(end == "", "b").when(F.right(end, F.lit(1)).isin(".", "!", "?"), ".").otherwise("t").alias("own"),
    )
    copies = table.groupBy("digest").agg(F.min("rank").alias("earliest"), F.count("*").alias("n")).where("n > 1").select("digest", "earliest")
    fault = F.when(F.col("own") == "b", "b").when(F.col("rank") > F.col("earliest"), "d").otherwise(F.col("own"))
    return rows.join(copies, "digest", "left").select("conv_id", "turn", "rank", "seg", "initial", fault.alias("fault"))


# ---------------------------------------------------------------- edits

_TABLE = "array<struct<entry:int, last:int, cost:long, edits:string>>"
_SEGMENT = f"conv_id long, seg long, turns array<long>, initials string, faults string, ways {_TABLE}"


def _solve(size: int, batches):
    """The ways through each segment."""
    memory: dict[tuple, list] = {}
    for b in batches:
        ways = []
        for low, high, initials, faults in zip(*(b.column(c).to_pylist() for c in ("low", "high", "initials", "faults")), strict=True):
            # a conversation may go on beyond the block only at its edges
            before, after = low % size == 0, high % size == size - 1
            key = (initials, faults, before, after)
            if key not in memory:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                memory[key] = [
                    {"entry": entry, "last": last, "cost": cost, "edits": edits}
                    for entry in (range(4) if before else (START,))
                    for last, (cost, edits) in search(initials, faults, entry, range(4) if after else ACCEPTED, each=after or before).items()
                ]
            ways.append(memory[key])
        kind = pa.list_(pa.struct([("entry", pa.int32()), ("last", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "seg", "turns", "initials", "faults")), pa.array(ways, kind)], ["conv_id", "seg", "turns", "initials", "faults", "ways"])


#: A row per segment: the state it starts in and its edits; with its conversation's last segment, what is told of the whole.
_EDITS = "conv_id long, seg long, entry int, edits string, parts int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _chained(held: list[dict]) -> list[tuple]:
    """Rows of _EDITS for the segments of one conversation."""
    best, steps = {START: (0, "")}, []
    for s in held:
        new, back = {}, {}
        for w in s["ways"]:
            if w["entry"] in best:
                cost, edits = best[w["entry"]]
                way = (cost + w["cost"], edits + w["edits"])
                if w["last"] not in new or way < new[w["last"]]:
                    new[w["last"]], back[w["last"]] = way, w
        best = new
        steps.append(back)
    last = min((s for s in ACCEPTED if s in best), key=lambda s: best[s])
    cost, audit = best[last]
    chosen, state = [], last
    for back in reversed(steps):
        chosen.append(back[state])
        state = back[state]["entry"]
    chosen.reverse()
    turns = [t for s in held for t in s["turns"] if t is not None]
    initials, faults = "".join(s["initials"] for s in held), "".join(s["faults"] for s in held)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(initials[i : i + 2] not in LEGAL_PAIRS for i in range(len(initials) - 1))
    whole = (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit)
    none = (None,) * len(whole)
    return [(s["conv_id"], s["seg"], w["entry"], w["edits"], len(held), *(whole if s is held[-1] else none)) for s, w in zip(held, chosen, strict=True)]


def _chain(schema: pa.Schema, batches):
    held: list[dict] = []
    for b in batches:
        out = []
        for row in b.to_pylist():
            if held and held[0]["conv_id"] != row["conv_id"]:
                out += _chained(held)
                held = []
            held.append(row)
        yield _batch(out, schema)
    if held:
        yield _batch(_chained(held), schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def edits(table: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The cheapest edits of ranked rows, as a written table: a row per segment, with its conversation's findings at the last."""
    spark = table.sparkSession
    ship_package(spark)
    row = F.struct("rank", "turn", "initial", "fault")
    grouped = with_faults(table).groupBy("conv_id", "seg").agg(F.array_sort(F.collect_list(row)).alias("rows"))  # at most `size` rows
    joined = lambda c: F.array_join(F.transform("rows", lambda x: x[c]), "")
    segments = grouped.select(
        "conv_id", "seg", F.element_at("rows", 1)["rank"].alias("low"), F.element_at("rows", -1)["rank"].alias("high"),
        F.transform("rows", lambda x: x["turn"]).alias("turns"), joined("initial").alias("initials"), joined("fault").alias("faults"),
    )
    solved = segments.mapInArrow(partial(_solve, size), _SEGMENT)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chained = solved.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(partial(_chain, _arrow(_EDITS)), _EDITS)
    return C.materialise(chained, "edits")


# ---------------------------------------------------------------- repaired turns

_TURN = "conv_id long, seg long, item long, edit string, role string, text string"
_DIGEST = "conv_id long, seg long, item long, sha256 string, body binary"


class _Walk:
    """Applies a segment's edits to its rows as they come."""

    def __init__(self, entry: int, edits: str):
        self.state, self.left = entry, iter(edits)

    def _emit(self, edit: str, role: str, text: str):
        self.state = NEXT[self.state, role[0]]
        return edit, role, text

    def row(self, role: str, text: str):
        """The turns up to and with this row."""
        for edit in self.left:
            if edit == "I":
                yield self._emit("I", WORD[FORCED[self.state]], "")
                continue
            if edit == "K":
                yield self._emit("K", role, text)
            elif edit == "R":
                yield self._emit("R", WORD[FORCED[self.state]], text)
            return

    def rest(self):
        for _ in self.left:
            yield self._emit("I", WORD[FORCED[self.state]], "")


def _walked(batches):
    """(conv_id, seg, parts, turns) of each stretch of a segment, whose edits come before its rows; None for parts at its end."""
    key = walk = parts = None
    for b in batches:
        for conv, seg, role, text, entry, todo, n in zip(*(b.column(c).to_pylist() for c in ("conv_id", "seg", "role", "text", "entry", "edits", "parts")), strict=True):
            if todo is not None:
                if walk:
                    yield (*key, parts, walk.rest(), True)
                key, walk, parts = (conv, seg), _Walk(entry, todo), n
            else:
                yield (*key, parts, walk.row(role, text), False)
        yield None  # a batch is through
    if walk:
        yield (*key, parts, walk.rest(), True)


def _turns(schema: pa.Schema, batches):
    out, at, before = [], 0, None
    for x in _walked(batches):
        if x is None:
            yield _batch(out, schema)
            out = []
            continue
        conv, seg, _, turns, _ = x
        at = at if before == (conv, seg) else 0
        before = (conv, seg)
        for edit, role, text in turns:
            out.append((conv, seg, at, edit, role, text))
            at += 1
    yield _batch(out, schema)


def _digests(schema: pa.Schema, batches):
    """The digest of conversations of one segment; of others, what is to be digested, turn by turn."""
    out, at, before, sha = [], 0, None, None
    for x in _walked(batches):
        if x is None:
            yield _batch(out, schema)
            out = []
            continue
        conv, seg, parts, turns, ended = x
        if before != (conv, seg):
            before, at, sha = (conv, seg), 0, hashlib.sha256()
        for _, role, text in turns:
            body = f"{role}:{text}".encode()
            if parts > 1:
                out.append((conv, seg, at, None, body))
            else:
                sha.update(b"\n" + body if at else body)
            at += 1
        if ended and parts == 1:
            out.append((conv, seg, at, sha.hexdigest(), None))
    yield _batch(out, schema)


def _joined(schema: pa.Schema, batches):
    """Digests of conversations whose turns come in order."""
    key, sha, some = None, None, False
    for b in batches:
        out = []
        for conv, body in zip(b.column("conv_id").to_pylist(), b.column("body").to_pylist(), strict=True):
            if not some or key != conv:
                if some:
                    out.append((key, sha.hexdigest()))
                key, sha, some = conv, hashlib.sha256(body), True
            else:
                sha.update(b"\n" + body)
        yield _batch(out, schema)
    if some:
        yield _batch([(key, sha.hexdigest())], schema)


def _met(table: DataFrame, found: DataFrame) -> DataFrame:
    """Edits and rows of each segment in one sorted stretch, the edits first."""
    rows = table.select("conv_id", "seg", "rank", "role", "text")
    both = rows.unionByName(found.select("conv_id", "seg", F.lit(-1).cast("long").alias("rank"), "entry", "edits", "parts"), allowMissingColumns=True)
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, "conv_id", "seg").sortWithinPartitions("conv_id", "seg", "rank")


def repair(conversations: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The repaired turns: conv_id, seg and item (their order), edit (K, R or I), role, text."""
    table = ranked(conversations, size)
    return _met(table, edits(table, size)).mapInArrow(partial(_turns, _arrow(_TURN)), _TURN)


def findings(conversations: DataFrame, size: int = SEGMENT) -> DataFrame:
    """A row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    spark = conversations.sparkSession
    table = ranked(conversations, size)
    found = edits(table, size)
    told = C.materialise(_met(table, found).mapInArrow(partial(_digests, _arrow(_DIGEST)), _DIGEST), "digests")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = "conv_id long, sha256 string"
    long = told.where("body is not null").select("conv_id", "seg", "item", "body").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "seg", "item")
    long = long.mapInArrow(partial(_joined, _arrow(out)), out)
    digests = told.where("sha256 is not null").select("conv_id", "sha256").unionByName(long).select(F.col("conv_id").alias("_id"), "sha256")
    whole = found.where("audit is not null").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    nothing = hashlib.sha256(b"").hexdigest()
    met = whole.join(digests, whole["conv_id"].eqNullSafe(digests["_id"]), "left").drop("_id")
    return met.withColumn("repaired_sha256", F.coalesce("sha256", F.lit(nothing))).drop("sha256")


# ---------------------------------------------------------------- query


def damaged(conversations: DataFrame) -> DataFrame:
    """The faults of the contract, by a checksum of id and turn."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = _clean(conversations).withColumn("kind", kind).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_structure_repair(spark, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = findings(damaged(given)).withColumnRenamed("conv_id", "_id")
    every = given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(found, every["conv_id"].eqNullSafe(found["_id"]), "left").drop("_id")
    return joined.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna({"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})


# Unsigned CRC-32 of ASCII text in SQL, bit by bit (0xEDB88320 is the reversed polynomial, a fixed value).
CRC32_SQL = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] for c in string_split({text}, '')])),
    lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)))"""


def _step_sql() -> str:
    """One row of the lattice: the best (cost, edits) by last role (0 none, 1 system, 2 user, 3 assistant), then insertions."""
    add = lambda way, cost, edit: f"{{'c': {way}.c + {cost}, 'a': {way}.a || {edit}}}"
    best = lambda *ways: f"list_min([{', '.join(ways)}])"
    stay = lambda way: add(way, 4, "'D'")
    to = lambda way, letter: add(way, f"(CASE WHEN initial = '{letter}' THEN 0 ELSE 3 END + charge)", f"CASE WHEN initial = '{letter}' THEN 'K' ELSE 'R' END")
    system = add("s0", "CASE WHEN initial = 's' THEN charge ELSE 1000000000 END", "'K'")
    return f"""SELECT conv_id, i, {stay('s0')} AS s0, {best(stay('s1'), system)} AS s1,
            {best(stay('s2'), to('s0', 'u'), to('s1', 'u'), to('s3', 'u'))} AS s2, {best(stay('s3'), to('s2', 'a'))} AS s3"""


def _insert_sql(source: str) -> str:
    """Up to two insertions in a row; more never pay."""
    for _ in range(2):
        source = f"""SELECT conv_id, i, s0, s1, list_min([s2, {{'c': s0.c + 3, 'a': s0.a || 'I'}}, {{'c': s1.c + 3, 'a': s1.a || 'I'}}, {{'c': s3.c + 3, 'a': s3.a || 'I'}}]) AS s2,
            list_min([s3, {{'c': s2.c + 3, 'a': s2.a || 'I'}}]) AS s3 FROM ({source})"""
    return source


ORACLE_SQL = f"""
WITH RECURSIVE given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {CRC32_SQL.format(text="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
    FROM conversations),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM given WHERE kind <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
        rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended, left(role, 1) AS first
    FROM damaged),
marked AS (
    SELECT conv_id, turn, n, role, text, first,
        CASE WHEN ended = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd' WHEN right(ended, 1) IN ('.', '!', '?') THEN '.' ELSE 't' END AS fault,
        lag(first) OVER (PARTITION BY conv_id ORDER BY n) || first AS pair
    FROM placed),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
        count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows
    FROM marked GROUP BY conv_id),
lattice AS (
    SELECT conv_id, 0::BIGINT AS i, s0, s1, s2, s3 FROM ({_insert_sql("SELECT conv_id, 0 AS i, {'c': 0::BIGINT, 'a': ''} AS s0, {'c': 1000000000::BIGINT, 'a': ''} AS s1, {'c': 1000000000::BIGINT, 'a': ''} AS s2, {'c': 1000000000::BIGINT, 'a': ''} AS s3 FROM counted")})
    UNION ALL
    SELECT conv_id, i::BIGINT, s0, s1, s2, s3 FROM ({_insert_sql(_step_sql() + " FROM (SELECT l.conv_id, l.i + 1 AS i, s0, s1, s2, s3, m.first AS initial, CASE WHEN fault IN ('b', 'd') THEN 1000000000 WHEN fault = 't' THEN 3 ELSE 0 END AS charge FROM lattice l JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.n = l.i + 1)")})),
solved AS (
    SELECT c.*, list_min([l.s0, l.s3]) AS best FROM counted c JOIN lattice l ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.i = c.rows),
letters AS (  -- each edit with the row that it consumes (for an insertion, none) and its place among turns that stay
    SELECT conv_id, k, edit, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER w AS n, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER w AS place
    FROM (SELECT conv_id, unnest(string_split(best.a, '')) AS edit, generate_subscripts(string_split(best.a, ''), 1) AS k FROM solved WHERE best.a <> '')
    WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
turns AS (
    SELECT l.conv_id, l.k, l.place, l.edit, m.role, m.text,
        first_value(CASE WHEN l.edit = 'K' AND m.first = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id ORDER BY l.place) AS system
    FROM letters l LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.n = l.n AND l.edit <> 'I'
    WHERE l.edit <> 'D'),
told AS (
    SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS body
    FROM turns GROUP BY conv_id)
SELECT e.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank, coalesce(s.duplicate, 0)::BIGINT AS duplicate,
    coalesce(s.truncated, 0)::BIGINT AS truncated, coalesce(s.illegal, 0)::BIGINT AS illegal, coalesce(s.best.c, 0)::BIGINT AS cost,
    coalesce(s.best.a, '') AS audit, sha256(coalesce(t.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""
