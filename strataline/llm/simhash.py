"""SimHash near-duplicates by covering locality-sensitive hashing.

A text is lower-cased (A-Z), its words are joined by single spaces, and every 4-word shingle votes with its XXH64 (seed 42) on
64 bits. Texts link if their fingerprints differ in at most RADIUS bits. Each bit i gets a nonzero vector m(i) of RADIUS + 1
bits; table v (every nonzero vector) keeps the bits with <m(i), v> = 1. The m(i) of RADIUS differing bits do not span the
space, so some v is orthogonal to all of them: the pair has equal masked fingerprints in that table, always.

Equal fingerprints are one node from the start. Nodes are counted by bucket first. Buckets of up to `limit` nodes are read as
sorted runs: the links found in a run are those of a spanning forest (each verified), so it emits fewer links than it has
members. The nodes of larger buckets never meet in one task: two nodes of one bucket within 4 bits share a value within 2
bits of both, so each node is sent, from where it lies, to all values within 2 bits of it outside the mask, and nodes of one
value link to the smallest: linear and exact, of any size. Classes reach documents by fingerprint; a fingerprint of more than
COPIES documents is looked up in a table of its own, which holds at most documents / COPIES rows.

Defined results: a null text is empty; a text without words has fingerprint zero, linked like any other; a null id gets a
row of its own and counts as largest (component_id is null only if all members' ids are); repeated rows give repeated
results; an empty table gives no rows; columns beyond id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import common as C
from .graph import components
from .xxh64 import hash_spans

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Nodes of a bucket that one task compares; larger buckets go through shared values.
BUCKET_LIMIT = 8192
#: Documents of one fingerprint from which on its class is broadcast, not joined by key.
COPIES = 100_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def fingerprints(data: np.ndarray, off: np.ndarray, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """uint64 fingerprint of each document of a chunk."""
    n = len(off) - 1
    out = np.zeros(n, np.uint64)
    starts, ends, first = C.words(data, off)
    if not len(starts):
        return out
    # every word and one space, gap by gap
    length = ends - starts + 1
    new = np.concatenate([[0], np.cumsum(length)])
    joined = np.full(new[-1], 0x20, np.uint8)
    inside = np.ones(new[-1], bool)
    inside[new[1:] - 1] = False
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] += 1
    np.subtract.at(mark, ends, 1)
    joined[inside] = _LOWER[data[np.cumsum(mark[:-1], dtype=np.int8) > 0]]
    count = np.diff(first)
    at = C.window_starts(first, size)
    short = np.flatnonzero((count > 0) & (count < size))
    begin = np.concatenate([at, first[short]])
    last = np.concatenate([at + size - 1, first[short + 1] - 1])
    order = np.argsort(begin, kind="stable")
    begin, last = begin[order], last[order]
    h = hash_spans(joined, new[begin], new[last + 1] - 1, seed)
    doc = np.searchsorted(first, begin, side="right") - 1
    some, where, total = np.unique(doc, return_index=True, return_counts=True)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = np.empty((len(some), 64), np.int64)
    for i, (a, m) in enumerate(zip(where.tolist(), total.tolist(), strict=True)):
        votes[i] = bits[a : a + m].sum(axis=0, dtype=np.int32)
    out[some] = np.packbits(2 * votes > total[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def masks(radius: int = RADIUS) -> list[int]:
    """The masks of the covering family, 2**(radius+1) - 1 of them."""
    top = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(64) if bin((i % top + 1) & v).count("1") & 1) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _runs(batches, keys: list[str]):
    """Sorted batches, cut so that no run of equal keys is split; (key columns, fp) arrays. Runs are of a bounded length."""
    held = None
    for b in batches:
        cols = [b.column(k).to_numpy() for k in [*keys, "fp"]]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = np.ones(len(cols[0]), bool)
        for k in range(len(keys)):
            last &= cols[k] == cols[k][-1]
        cut = len(last) - int(last.sum())
        held = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols]
    if held is not None:
        yield held


def _forest(fp: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of the nodes within `radius` bits of each other."""
    a, b = [], []
    rest = fp.view(np.uint64)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = np.bitwise_count(rest ^ node) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue.extend(found)
                a.extend(found.view(np.int64).tolist())
                b.extend([int(node.view(np.int64))] * len(found))
    return a, b


def _bucket_links(radius: int):
    """Links of the runs of equal (t, key)."""

    def run(batches):
        for t, key, fp in _runs(batches, ["t", "key"]):
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(t)))
            two = start[size == 2]
            ok = np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= radius
            a, b = [fp[two + 1][ok]], [fp[two][ok]]
            for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                x, y = _forest(fp[s : s + n], radius)
                a.append(np.array(x, np.int64))
                b.append(np.array(y, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["u", "v"])

    return run


def _spread(radius: int, family: list[int]):
    """All values within radius / 2 bits of a node outside its table's mask."""

    def run(batches):
        for b in batches:
            t, fp = b.column("t").to_numpy(), b.column("fp").to_numpy()
            for table in np.unique(t):
                free = [np.uint64(1 << i) for i in range(64) if not family[table] >> i & 1]
                flips, level = [np.uint64(0)], [(0, np.uint64(0))]
                for _ in range(radius // 2):
                    level = [(j + 1, f | free[j]) for i, f in level for j in range(i, len(free))]
                    flips += [f for _, f in level]
                near = np.array(flips, np.uint64)
                own = fp[t == table].view(np.uint64)
                for i in range(0, len(own), 512):
                    part = own[i : i + 512]
                    value = (part[:, None] ^ near[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), table, np.int32)), pa.array(value.view(np.int64)), pa.array(np.repeat(part, len(near)).view(np.int64))], ["t", "key", "fp"])

    return run


def _value_links(batches):
    """Links of the members of each value to its first member; runs may be of any length."""
    last = None
    for b in batches:
        t, key, fp = (b.column(k).to_numpy() for k in ("t", "key", "fp"))
        if not len(t):
            continue
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1])
        head = fp[np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))]
        if last is not None and last[:2] == (t[0], key[0]):
            upto = np.flatnonzero(new)[1] if new.sum() > 1 else len(t)
            head[:upto] = last[2]
        last = (t[-1], key[-1], head[-1])
        ok = head != fp
        yield pa.RecordBatch.from_arrays([pa.array(fp[ok]), pa.array(head[ok])], ["u", "v"])


def link_nodes(nodes: DataFrame, radius: int = RADIUS, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (u, v) with the components of the graph `at most radius bits apart` on distinct fp values (long)."""
    if radius % 2:
        raise ValueError("an even radius is needed")
    family = masks(radius)
    signed = [_signed(m) for m in family]
    tables = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed))))
    keyed = nodes.select("fp", tables.alias("e")).select("e.t", "e.key", "fp")
    hot = C.materialise(keyed.groupBy("t", "key").count().where(F.col("count") > limit).select("t", "key"), "buckets")
    usual = keyed.join(hot, ["t", "key"], "left_anti").repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    small = usual.mapInArrow(_bucket_links(radius), "u long, v long")
    spread = keyed.join(hot, ["t", "key"], "left_semi").select("t", "fp").mapInArrow(_spread(radius, family), "t int, key long, fp long")
    large = spread.repartition("t", "key").sortWithinPartitions("t", "key", "fp").mapInArrow(_value_links, "u long, v long")
    return small.unionByName(large)


def _fingerprint(batches):
    for part in C.chunks(batches, "text"):
        fp = fingerprints(*C.utf8(part.column("text")))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(fp.view(np.int64))], ["doc_id", "key", "fp"])


def _classes(docs: DataFrame, radius: int, limit: int) -> DataFrame:
    """doc_id, key (hash of the text), fp, root (smallest fingerprint of the class), component_id of every row."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))
    marked = C.materialise(rows.mapInArrow(_fingerprint, "doc_id long, key long, fp long"), "fingerprints")
    nodes = C.materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "nodes")
    root = components(link_nodes(nodes.select("fp"), radius, limit))
    named = nodes.join(root, nodes["fp"] == root["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low", "n")
    best = named.groupBy("root").agg(F.min("low").alias("component_id"))
    label = C.materialise(named.join(best, "root").select("fp", "root", "component_id", "n"), "classes")
    many = F.broadcast(label.where(F.col("n") > COPIES).drop("n"))  # at most a row per COPIES documents
    usual = marked.join(many.select("fp"), "fp", "left_anti").join(label.where(F.col("n") <= COPIES).drop("n"), "fp")
    return usual.unionByName(marked.join(many, "fp"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id (the smallest doc_id of its class)."""
    return _classes(docs, radius, limit).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the document with the smallest id stays (null ids are largest; of repeated rows, one)."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    own, keep_id, keep_key = C.fresh(docs.columns, "own_key", "keep_id", "keep_key")
    keep = _classes(docs, RADIUS, BUCKET_LIMIT).groupBy("root").agg(F.min(place).alias("k")).select(F.col("k.doc_id").alias(keep_id), F.col("k.key").alias(keep_key)).distinct()
    marked = docs.withColumn(own, F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(keep_id)) & (F.col(own) == F.col(keep_key))
    return marked.join(keep, same, "left_semi").dropDuplicates(["doc_id", own]).select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
