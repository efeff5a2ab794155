"""Prefix trie of conversations from rolling fingerprints.

A node of depth d is a distinct sequence of the first d turns. Turns are digested (SHA-256 of role and text); over rows
range-partitioned by conversation and place, numpy scans roll a polynomial fingerprint modulo 2^61 - 1 along each conversation,
and a conversation cut by partitions is carried on from a number per partition. Rows of equal depth and fingerprint are a
candidate group. Its representative is the smallest conversation in it; every member's turn (all 256 bits) and the fingerprint
before it are compared with the representative's, as smallest and largest values of the group. If all groups agree, then by
induction each holds equal sequences, turn by turn. Rows of a group that do not agree get labels from what differs, labels are
rolled up along the conversations likewise and split the groups from there on, and all are verified again.

Children are counted at their parent's key. Sums over a subtree need no walk by level, so depth costs no rounds: each node is
charged to its smallest member, charges are added up per conversation, and a node adds up those of its members, less what its
own smallest member is charged for above it (a running sum along that conversation). The ids of the conversations that end in
a node are range-sorted, joined in stretches and hashed from stretch to stretch, so no task holds a node's ids.

Defined results: a null role or text is empty; null turns come first; rows of equal turns follow role, the first 64 characters
of text, then a digest of both; rows without a conversation id take no part; conversations without turns (`also`) end in the
root; an empty table gives no rows, not even a root; columns beyond the four are not read.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import common as C
from .repair import CRC32_SQL

U64 = np.uint64
PRIME = (1 << 61) - 1
#: The bases of the fingerprint and of the labels (fixed values).
BASE, LABEL_BASE = 0x1B873593CC9E2D51 % PRIME, 0x0E6546B64F0A3D57 % PRIME
#: Ids that are joined into one row before a node's ids are hashed.
STRETCH = 4096
#: Rounds of splitting; the first one already leaves nothing but collisions of the labels.
ROUNDS = 8
LANES = ["d0", "d1", "d2", "d3"]


# ---------------------------------------------------------------- scans


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2^61 - 1."""
    low31, low30 = U64((1 << 31) - 1), U64((1 << 30) - 1)
    ah, al, bh, bl = a >> U64(31), a & low31, b >> U64(31), b & low31
    mid = al * bh + ah * bl
    x = (ah * bh << U64(1)) + (mid >> U64(30)) + ((mid & low30) << U64(31)) + al * bl
    x = (x >> U64(61)) + (x & U64(PRIME))
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a + b
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    out, square, e = np.ones(len(exponents), U64), base, exponents.astype(np.int64)
    while e.any():
        out = np.where(e & 1, times(out, np.full(len(out), square, U64)), out)
        square, e = square * square % PRIME, e >> 1
    return out


def roll(values: np.ndarray, place: np.ndarray, base: int) -> np.ndarray:
    """Within runs (place counts from 0 in each): v0 base^k + v1 base^(k-1) + ... + vk, by doubling steps."""
    out, step, factor = values.astype(U64), 1, base
    longest = int(place.max(initial=0))
    while step <= longest:
        on = np.flatnonzero(place >= step)
        out[on] = plus(out[on], times(out[on - step], np.full(len(on), factor, U64)))
        step, factor = step * 2, factor * factor % PRIME
    return out


def add_up(values: np.ndarray, place: np.ndarray, base: int) -> np.ndarray:
    """Sums within runs, modulo 2^64."""
    total = np.cumsum(values)
    first = np.arange(len(values)) - place
    return total - (total[first] - values[first])


def _places(conv: np.ndarray) -> np.ndarray:
    """How many rows of the same conversation come before, in sorted rows."""
    if not len(conv):
        return np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
    return np.arange(len(conv)) - np.repeat(new, np.diff(np.append(new, len(conv))))


def _local(value: str, base: int, batches):
    """Adds `k` (rows of the conversation so far in this partition, from 1) and `acc` (value rolled over them, or added up)."""
    conv, count, acc = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        own, v = b.column("conv_id").to_numpy(), b.column(value).to_numpy().view(U64)
        place = _places(own)
        # the conversation that the last batch left open goes on
        going = int(np.searchsorted(own, own[0], side="right")) if own[0] == conv else 0
        if base:
            got = roll(v % U64(PRIME), place, base)
            if going:
                got[:going] = plus(got[:going], times(np.full(going, acc, U64), powers(base, place[:going] + 1)))
        else:
            got = add_up(v, place, 1)
            got[:going] += U64(acc)
        k = place + 1
        k[:going] += count
        conv, count, acc = own[-1], int(k[-1]), int(got[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k), pa.array(got.view(np.int64))], [*b.schema.names, "k", "acc"])


def _carried(carry: dict, value: str, base: int, out: str, batches):
    """`acc` with what the partitions before have of the conversation, as column `out`; `k` counts all its rows.

    With a base also what `out` was at the row before.
    """
    undo = pow(base, -1, PRIME) if base else 0
    for b in batches:
        part, own = b.column("part").to_numpy(), b.column("conv_id").to_numpy()
        k, acc = b.column("k").to_numpy().copy(), b.column("acc").to_numpy().view(U64).copy()
        for p in np.unique(part):
            if int(p) in carry:
                conv, count, before = carry[int(p)]
                on = np.flatnonzero((part == p) & (own == conv))
                more = np.full(len(on), before, U64)
                acc[on] = plus(acc[on], times(more, powers(base, k[on]))) if base else acc[on] + more
                k[on] += count
        new = {out: acc}
        if base:
            v = b.column(value).to_numpy().view(U64) % U64(PRIME)
            new[f"{out}_before"] = times(plus(acc, U64(PRIME) - v), np.full(len(v), undo, U64))
        named = {n: c for n, c in zip(b.schema.names, b.columns, strict=True) if n not in ("part", "k", "acc")}
        yield pa.RecordBatch.from_arrays([*named.values(), pa.array(k), *(pa.array(x.view(np.int64)) for x in new.values())], [*named, "k", *new])


def _fold(rows: list, base: int) -> dict:
    """What each partition is to carry on: (conversation, rows, value), from the first and last rows of all."""
    carry, prior = {}, None
    for r in sorted(rows, key=lambda r: r["part"]):
        conv, k, acc = r["conv"], r["k"], r["acc"] % (1 << 64)
        if prior and prior[0] == r["first"]:
            carry[r["part"]] = prior
            if conv == r["first"]:
                k, acc = k + prior[1], (prior[2] * pow(base, k, PRIME) + acc) % PRIME if base else (prior[2] + acc) % (1 << 64)
        prior = (conv, k, acc)
    return carry


def scan(df: DataFrame, order: list, value: str, out: str, base: int = 0) -> DataFrame:
    """Rows with `k`, their place in their conversation from 1 in the given order, and `value` rolled (base) or added up to there.

    `order` starts with conv_id. A row per partition reaches the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    table = C.materialise(ranged.mapInArrow(partial(_local, value, base), f"{kept}, part int, k long, acc long"), "scan")
    at = F.struct("conv_id", "k")
    edges = table.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("conv"), F.max_by("k", at).alias("k"), F.max_by("acc", at).alias("acc")).collect()
    new = f"k long, `{out}` long" + f", `{out}_before` long" * bool(base)
    return table.mapInArrow(partial(_carried, _fold(edges, base), value, base, out), f"{kept}, {new}")


# ---------------------------------------------------------------- turns


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, k (from 1), the lanes of the turn's digest and the UTF-8 bytes of its text, for every row with an id."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.substring(role, 1, 64).alias("r"), F.substring(text, 1, 64).alias("t"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("hex"), F.octet_length(text).cast("long").alias("bytes"),
    )
    lanes = [F.conv(F.substring("hex", 1 + 15 * i, 15), 16, 10).cast("long").alias(c) for i, c in enumerate(LANES)]  # 240 bits
    rows = rows.select("conv_id", "turn", "r", "t", *lanes, "bytes", F.monotonically_increasing_id().alias("uid"), F.lit(0).cast("long").alias("zero"))
    return scan(rows, ["conv_id", "turn", "r", "t", *LANES, "uid"], "zero", "none").select("conv_id", "k", *LANES, "bytes")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: the first h turns of the first of each five, then the own ones after the first h; and all ids."""
    base, h = (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % 9).alias("h")
    ids = C.materialise(rows.select("conv_id").distinct(), "ids")
    heads = rows.where("k <= 8").withColumnRenamed("conv_id", "base")
    known = heads.groupBy("base").agg(F.count("*").alias("n"))
    copied = ids.select("conv_id", base, h).join(heads, "base").where("k <= h").select("conv_id", "k", *LANES, "bytes")
    own = rows.select("*", base, h).where("k > h").join(known, "base", "left")
    moved = F.col("k") - F.col("h") + F.least("h", F.coalesce("n", F.lit(0)))
    return copied.unionByName(own.select("conv_id", moved.alias("k"), *LANES, "bytes")), ids


# ---------------------------------------------------------------- nodes

NODE = ["depth", "fp", "label"]
BEFORE = ["fp_before", "label_before"]


def _rolled(rows: DataFrame, value: str, out: str, base: int, bits: int) -> DataFrame:
    got = scan(rows, ["conv_id", "depth"], value, out, base).drop("k")
    mask = (1 << bits) - 1
    return got.withColumn(out, F.col(out).bitwiseAND(mask)).withColumn(f"{out}_before", F.col(f"{out}_before").bitwiseAND(mask))


def _grouped(members: DataFrame) -> DataFrame:
    """Candidate nodes; clean: every member's turn, and the node that it comes from, are those of the representative."""
    same = [*LANES, *BEFORE]
    ends = [f(c).alias(f"{c}_{n}") for c in same for f, n in ((F.min, "low"), (F.max, "high"))]
    clean = F.lit(True)
    for c in same:
        clean = clean & (F.col(f"{c}_low") == F.col(f"{c}_high"))
    groups = members.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"), *ends)
    return groups.select(*NODE, "n_convs", "conv_id", "bytes", *(F.col(f"{c}_low").alias(c) for c in BEFORE), clean.alias("clean"))


def verified(rows: DataFrame, bits: int = 61) -> tuple[DataFrame, DataFrame]:
    """(members, nodes): a row per conversation and depth with the key of its node, and a row per node; keys are exact.

    bits: how much of the fingerprint is used.
    """
    zero = F.lit(0).cast("long")
    turns = rows.withColumnRenamed("k", "depth")
    members = C.materialise(_rolled(turns, "d0", "fp", BASE, bits).select("*", zero.alias("mark"), zero.alias("label"), zero.alias("label_before")), "members")
    for _ in range(ROUNDS):
        nodes = C.materialise(_grouped(members), "nodes")
        bad = nodes.where("not clean").select(*NODE, F.lit(True).alias("bad"))
        if not bad.head(1):
            return members, nodes.drop("clean")
        mark = F.when(F.col("bad"), F.xxhash64("mark", *LANES, *BEFORE)).otherwise(F.col("mark"))
        marked = members.join(bad, NODE, "left").withColumn("mark", mark).drop("bad", "label", "label_before")
        members = C.materialise(_rolled(marked, "mark", "label", LABEL_BASE, 61), "members")
    raise RuntimeError("labels collide")


# ---------------------------------------------------------------- ids that end in a node


def _stretches(batches):
    """Ids in a row of one node, joined by commas, up to STRETCH of them: a row of its key, the first id and the text."""
    for b in batches:
        if not b.num_rows:
            continue
        key, conv = np.stack([b.column(c).to_numpy() for c in NODE]), b.column("conv_id").to_numpy()
        new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])
        first = np.flatnonzero(new)
        place = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
        cut = np.flatnonzero(place % STRETCH == 0)
        text = [",".join(map(str, x.tolist())) for x in np.split(conv, cut[1:])]
        yield pa.RecordBatch.from_arrays([*(pa.array(x[cut]) for x in key), pa.array(conv[cut]), pa.array(text)], [*NODE, "first", "ids"])


def _hashed(batches):
    """SHA-256 over each node's stretches as they come."""
    key = sha = None

    def row(done):
        return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k, _ in done], pa.int64()) for i in range(3)), pa.array([d for _, d in done], pa.string())], [*NODE, "ends_sha256"])

    for b in batches:
        done = []
        for *own, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            if own == key:
                sha.update(b"," + ids.encode())
            else:
                if key:
                    done.append((key, sha.hexdigest()))
                key, sha = own, hashlib.sha256(ids.encode())
        yield row(done)
    if key:
        yield row([(key, sha.hexdigest())])


def _ends(last: DataFrame) -> DataFrame:
    """The digest of the ids that end in each node, from a row (node, conv_id) per conversation."""
    parts = int(last.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ", ".join(f"{c} long" for c in NODE)
    order = [*NODE, "conv_id"]
    ranged = last.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_stretches, f"{key}, first long, ids string")
    return ranged.repartition(parts, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashed, f"{key}, ends_sha256 string")


# ---------------------------------------------------------------- trie


def trie(rows: DataFrame, ids: DataFrame, bits: int = 61) -> DataFrame:
    """A row per node, from numbered turns and the ids of all conversations, turnless ones included.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = rows.sparkSession
    ship_package(spark)
    members, nodes = verified(rows, bits)
    up = [(F.col("depth") - 1).alias("depth"), F.col("fp_before").alias("fp"), F.col("label_before").alias("label")]
    children = nodes.where("depth > 1").groupBy(*up).agg(F.count("*").alias("n_children"))
    charged = nodes.join(children, NODE, "left").fillna(0, ["n_children"]).withColumn("charge", (F.col("n_convs") - 1) * F.col("bytes"))
    charged = C.materialise(scan(charged, ["conv_id", "depth"], "charge", "total").withColumn("above", F.col("total") - F.col("charge")).drop("k", "total"), "charged")
    owners = charged.groupBy("conv_id").agg(F.sum("charge").alias("saved"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")).where("saved > 0 or leaf > 0")
    sums = members.select("conv_id", *NODE).join(owners, "conv_id").groupBy(*NODE).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("n_leaves"))
    at_end = members.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max_by("fp", "depth").alias("fp"), F.max_by("label", "depth").alias("label"))
    zero = F.lit(0).cast("long")
    last = ids.join(at_end, "conv_id", "left").select("conv_id", *(F.coalesce(c, zero).alias(c) for c in NODE))
    ends = C.materialise(_ends(last), "ends")
    # a row of sums for the root
    whole = ids.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    under = charged.agg(F.sum((F.col("depth") == 1).cast("long")).alias("children"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"), F.sum("charge").alias("saved")).first()
    nothing = hashlib.sha256(b"").hexdigest()
    out = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not whole["n"]:
        return spark.createDataFrame([], out)
    turnless = ends.where("depth = 0").first()
    root = [(whole["least"], 0, None, whole["n"], under["children"] or 0, under["leaves"] or 1, under["saved"] or 0, turnless["ends_sha256"] if turnless else nothing)]
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("fp_before"), F.col("label").alias("label_before"), F.col("conv_id").alias("parent"))
    full = charged.join(sums, NODE, "left").join(ends, NODE, "left").join(parents, ["depth", *BEFORE], "left")
    inner = full.select(
        "conv_id", "depth", F.when(F.col("depth") == 1, F.lit(whole["least"])).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("saved") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
    return inner.unionByName(spark.createDataFrame(root, out))


def prefix_trie(conversations: DataFrame, also: DataFrame | None = None, bits: int = 61) -> DataFrame:
    """The trie of conversations as they are; also: ids (conv_id) of conversations that may have no turn."""
    ship_package(conversations.sparkSession)
    rows = C.materialise(numbered(conversations), "turns")
    ids = rows.select("conv_id")
    if also is not None:
        ids = ids.unionByName(also.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")))
    return trie(rows, C.materialise(ids.distinct(), "ids"), bits)


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    ship_package(spark)
    rows = C.materialise(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")), "turns")
    return trie(*rebuilt(rows))


ORACLE_SQL = f"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC32_SQL.format(text="conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
known AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
rebuilt AS (
    SELECT i.conv_id, t.k, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.base AND t.k <= i.h
    UNION ALL
    SELECT i.conv_id, t.k - i.h + least(i.h, coalesce(n.n, 0)), t.role, t.text
    FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.k > i.h LEFT JOIN known n ON n.conv_id = i.base),
prefixes AS (
    SELECT conv_id, k AS depth, strlen(text) AS bytes, list(sha256(strlen(role) || ':' || role || text)) OVER w AS path
    FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
members AS (
    SELECT conv_id, depth, bytes, array_to_string(path, ',') AS node, array_to_string(path[:-2], ',') AS parent FROM prefixes
    UNION ALL SELECT conv_id, 0, 0, '', NULL FROM ids),
nodes AS (SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM members GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
below AS (  -- every node with each node above it, itself included, along its smallest member
    SELECT m.node, sum(CASE WHEN c.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.bytes) AS saved_tokens
    FROM nodes x JOIN members m ON m.conv_id = x.conv_id AND m.depth <= x.depth LEFT JOIN children c ON c.node = x.node
    GROUP BY m.node),
lengths AS (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id),
ends AS (SELECT m.node, sha256(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id)) AS ends_sha256 FROM members m JOIN lengths l USING (conv_id, depth) GROUP BY m.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children,
    b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN children c ON c.node = n.node LEFT JOIN ends e ON e.node = n.node
LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.parent
"""
