"""Substring dedup with a log-structured fingerprint index.

A window is WINDOW consecutive words of one document. The index holds the windows of all earlier batches as immutable runs,
one file per run and hash bucket, each sorted by a 64-bit key with a second 64-bit hash beside it. A batch is hashed in
blocks; a block settles repeats within itself and sends only the windows of each hash's smallest document to the hash's
bucket. There the blocks are merged, joined with the sorted runs, and every match of the key is verified by the second hash:
the two are a 128-bit digest of the window's words, from two non-linear mixes that do not fail together (`common.lanes`,
`common.window_lanes`; among 10**13 windows a false match is expected about 10**-13 times). The words themselves are not
kept, as the texts of earlier batches need not be at hand. The bucket then writes its new run. Runs have tiers: when more
than `max_runs` of one tier would stand, they merge with the new one into a run of the next tier (compaction).

A window is removed if its word sequence is in the index or starts in a document of the same batch with a smaller id; each
word under a removed window is removed. Windows are judged on the input. `dedup` feeds a whole table in ascending ranges of
doc_id, so history always has smaller ids; a batch fed to a standing index comes after all that is in it, whatever its ids.

Recovery: a call of `dedup` joins a standing index as a whole, when the rows of all its batches are written: one entry of
state.json, written under a temporary name and renamed. Until then the runs it writes, under names of its own, are known to it
alone, and the runs it merges stay. So a call that fails, in any batch, may be repeated and is judged against what stood
before it; what it left behind is removed with the next call that stands. A call that has a `name` is taken once; the same name
again is an error. One call at a time writes to an index.

Defined results: a null text is empty; texts under WINDOW words lose nothing; a null id counts as larger than all others and
equal to other nulls; rows with equal ids never remove each other's windows; repeated rows get repeated results; an empty
table gives no rows; operators read id and text only, and the stage keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import common as C

WINDOW = 13
BATCHES = 4
#: Runs of one tier that may stand.
MAX_RUNS = 1
#: Text bytes that one bucket's windows stem from, about; and the least number of buckets. The number does not follow the
#: session's partitions: a document's removed windows come back as one row per bucket.
BUCKET_BYTES, MIN_BUCKETS = 16 << 20, 64
LAST = (1 << 63) - 1


def window_hashes(data: np.ndarray, off: np.ndarray, size: int, bits: int = 64):
    """First word number per document, window numbers, and both 64-bit hashes of each window (the first cut to `bits`)."""
    starts, ends, first = C.words(data, off)
    at = C.window_starts(first, size)
    h1, h2 = C.window_lanes(C.lanes(data, starts, ends), at, size)
    return first, at, h1 >> np.uint64(64 - bits) << np.uint64(64 - bits) if bits < 64 else h1, h2


def _groups(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(sorted_values)))


def _later(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (h1, h2), and in that order: does the same window start in a smaller id."""
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    if len(a) and ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # one key, two windows
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    start = np.flatnonzero(new)
    d = ids[order]
    low = np.minimum.reduceat(d, start) if len(start) else d
    return order, d > np.repeat(low, np.diff(np.append(start, len(a))))


def _flag_rows(ids, keys, pos) -> list[tuple[int, int, bytes]]:
    """(id, key, packed positions) for each document; positions ascending."""
    order = np.lexsort((pos, keys, ids))
    ids, keys, pos = ids[order], keys[order], pos[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    start = np.flatnonzero(new)
    step = pos.astype(np.int64)
    step[1:] -= np.where(new[1:], 0, step[:-1])
    bounds = np.append(start, len(ids)).tolist()
    step = step.astype("<u4")
    return [(int(ids[a]), int(keys[a]), step[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_BLOCK = ["bucket", "id", "key", "data"]


def _block_rows(size: int, buckets: int, bits: int):
    """Block payloads by bucket (id null), and what a block settles itself, by document."""

    def run(batches):
        for part in C.chunks(batches, "text"):
            data, off = C.utf8(part.column("text"))
            ids, keys = part.column("id").to_numpy(), part.column("key").to_numpy()
            first, at, h1, h2 = window_hashes(data, off, size, bits)
            if not len(at):
                continue
            doc = np.searchsorted(first, at, side="right") - 1
            pos = (at - first[doc]).astype(np.uint32)
            order, gone = _later(h1, h2, ids[doc])
            settled = order[gone]
            rows = [(int(k % buckets), i, k, d) for i, k, d in _flag_rows(ids[doc[settled]], keys[doc[settled]], pos[settled])]
            left = np.ones(len(at), bool)
            left[settled] = False
            open_ = np.flatnonzero(left)
            bucket = ((h1[open_] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            open_, bucket = open_[by], bucket[by]
            start, count = _groups(bucket)
            for s, n in zip(start.tolist(), count.tolist(), strict=True):
                own = open_[s : s + n]
                used, where = np.unique(doc[own], return_inverse=True)
                p = pos[own].astype(np.int64)
                p[1:] -= np.where(where[1:] == where[:-1], p[:-1], 0)
                fields = [h1[own].tobytes(), h2[own].tobytes(), C.squeeze(np.diff(where, prepend=0).astype(np.uint32)), C.squeeze(p.astype(np.uint32)), ids[used].astype("<i8").tobytes(), keys[used].astype("<i8").tobytes()]
                head = np.array([n, *map(len, fields)], "<u4").tobytes()
                rows.append((int(bucket[s]), None, None, head + b"".join(fields)))
            for i in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 2000], strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], _BLOCK)

    return run


def _open_block(blob: bytes):
    head = np.frombuffer(blob, "<u4", 7)
    n, at, part = int(head[0]), 28, []
    for length in head[1:].tolist():
        part.append(blob[at : at + length])
        at += length
    where = np.cumsum(C.expand(part[2], n, "<u4").astype(np.int64))
    pos = C.expand(part[3], n, "<u4").astype(np.int64)
    new = np.ones(n, bool)
    new[1:] = where[1:] != where[:-1]
    total = np.cumsum(pos)
    base = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    pos = total - (total - pos)[base]
    return np.frombuffer(part[0], "<u8"), np.frombuffer(part[1], "<u8"), np.frombuffer(part[4], "<i8")[where], np.frombuffer(part[5], "<i8")[where], pos


def pack_run(h1: np.ndarray, h2: np.ndarray) -> bytes:
    """A sorted run: steps of the sorted keys as byte planes, and the second hashes."""
    a = C.squeeze(np.diff(h1, prepend=np.uint64(0)))
    return np.array([len(h1), len(a)], "<u8").tobytes() + a + h2.astype("<u8").tobytes()


def open_run(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, la = (int(x) for x in np.frombuffer(blob, "<u8", 2))
    return np.cumsum(C.expand(blob[16 : 16 + la], n, "<u8"), dtype=np.uint64), np.frombuffer(blob, "<u8", n, 16 + la)


def in_run(run: tuple[np.ndarray, np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Is each (h1, h2) in a sorted run: a match of the key counts only if the second hash agrees."""
    r1, r2 = run
    if not len(r1):
        return np.zeros(len(h1), bool)
    low = np.searchsorted(r1, h1)
    out = np.zeros(len(h1), bool)
    todo = np.flatnonzero(low < len(r1))
    while len(todo):
        todo = todo[r1[low[todo]] == h1[todo]]
        out[todo] |= r2[low[todo]] == h2[todo]
        low[todo] += 1
        todo = todo[~out[todo] & (low[todo] < len(r1))]
    return out


def _merge(root: str, runs: list[str], merged: list[str], new: str | None):
    """Judge one bucket of a batch against the runs; write its new run, with those of `merged` in it."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        passed = table.filter(table.column("id").is_valid()).select(["id", "key", "data"])
        blocks = [_open_block(b) for b in table.filter(table.column("id").is_null()).column("data").to_pylist()]
        out, keep = [], []
        h1, h2 = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if blocks:
            h1, h2, ids, keys, pos = (np.concatenate(x) for x in zip(*blocks, strict=True))
            blocks.clear()
            order, gone = _later(h1, h2, ids)
            h1, h2 = h1[order], h2[order]
        for name in runs:
            if (len(h1) or (new and name in merged)) and (blob := C.read_file(f"{root}/{name}/{bucket:06d}")) is not None:
                old = open_run(blob)
                if len(h1):
                    gone |= in_run(old, h1, h2)
                if new and name in merged:
                    keep.append(old)
        if len(h1):
            hit = order[gone]
            out = _flag_rows(ids[hit], keys[hit], pos[hit])
        if new:
            a, b = np.concatenate([h1, *(r[0] for r in keep)]), np.concatenate([h2, *(r[1] for r in keep)])
            by = np.lexsort((b, a)) if keep else np.arange(len(a))
            a, b = a[by], b[by]
            one = np.ones(len(a), bool)
            one[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            C.write_file(f"{root}/{new}/{bucket:06d}", [pack_run(a[one], b[one])])
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        mine = pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["id", "key", "data"])
        C.trim()
        return pa.concat_tables([passed, mine.cast(passed.schema)])

    return run


class FingerprintIndex:
    """The windows of all batches so far, under `root` in the shared folder; state.json names the runs and batches that count.

    lasting: whether runs that stand must be kept until what merges them stands.
    """

    def __init__(self, spark, root: str, buckets: int, window: int = WINDOW, max_runs: int = MAX_RUNS, bits: int = 64, lasting: bool = True):
        self.spark, self.root, self.window, self.max_runs, self.bits, self.lasting = spark, root, window, max_runs, bits, lasting
        found = C.read_file(f"{root}/state.json")
        self.state = json.loads(found) if found else {"runs": [], "next": 0, "buckets": buckets, "batches": []}
        self.buckets = self.state["buckets"]
        self.stood, self.mine = {n for n, _ in self.state["runs"]}, uuid.uuid4().hex[:12]
        ship_package(spark)

    def _place(self) -> tuple[int, list[str]]:
        """Tier of the next run, and the runs that go into it."""
        tier, merged = 0, []
        while len(same := [n for n, t in self.state["runs"] if t == tier]) >= self.max_runs:
            merged += same
            tier += 1
        return tier, merged

    def expect(self, name: str | None) -> None:
        """An error if what has this name is in the index."""
        if name is not None and name in self.state["batches"]:
            raise ValueError(f"batch {name} is in the index")

    def judge(self, batch: DataFrame, name: str | None = None, keep: bool = True):
        """(rows, done): (id, key, data) rows of the removed windows of a batch of (id, key, text), and what to call when the
        batch's results are written: its rows here go, and if `keep` it is in the index, for good unless done(stand=False)."""
        self.expect(name)
        new = f"run-{self.state['next']:06d}-{self.mine}" if keep else None
        tier, merged = self._place() if keep else (0, [])
        rows = batch.mapInArrow(_block_rows(self.window, self.buckets, self.bits), "bucket int, id long, key long, data binary")
        if merged:  # buckets without windows in this batch still have runs to merge
            rows = rows.unionByName(self.spark.range(self.buckets).selectExpr("cast(id as int) bucket", "0L id", "0L key", "cast('' as binary) data"))
        path = C.scratch(self.spark, "removed")
        flags = C.materialise(rows.groupBy("bucket").applyInArrow(_merge(self.root, [n for n, _ in self.state["runs"]], merged, new), "id long, key long, data binary"), "removed", path)

        def done(stand: bool = True) -> None:
            if new:
                self.state["runs"] = [[n, t] for n, t in self.state["runs"] if n not in merged] + [[new, tier]]
                self.state["next"] += 1
                for old in merged:
                    if not self.lasting or old not in self.stood:
                        C.remove(self.spark, f"{self.root}/{old}")
                if stand:
                    self.stand(name)
            C.remove(self.spark, path)

        return flags, done

    def stand(self, name: str | None = None) -> None:
        """What was judged since the last time is in the index from now on; runs that no longer count go."""
        self.state["batches"] += [name] if name is not None else []
        C.write_file(f"{self.root}/state.json", [json.dumps(self.state).encode()])
        self.stood = {n for n, _ in self.state["runs"]}
        for run in C.listed(self.spark, self.root):
            if run.startswith("run-") and run not in self.stood:
                C.remove(self.spark, f"{self.root}/{run}")


def _clean(names: list[str], size: int, own: list[str], made: list[str]):
    """Columns `names`, and `made`: word counts, hash of the kept words and, if a fourth is named, the text without removed words.

    own: the columns of the text and of its removed windows.
    """

    def run(batches):
        for part in C.chunks(batches, own[0]):
            data, off = C.utf8(part.column(own[0]))
            starts, ends, first = C.words(data, off)
            n = np.diff(first)
            mark = np.zeros(len(starts) + 1, np.int64)
            flags = part.column(own[1])
            for i in np.flatnonzero(flags.is_valid().to_numpy(zero_copy_only=False)).tolist():
                for blob in flags[i].as_py():
                    at = np.cumsum(np.frombuffer(blob, "<u4").astype(np.int64)) + first[i]
                    at = at[at + size <= first[i + 1]]
                    np.add.at(mark, at, 1)
                    np.subtract.at(mark, at + size, 1)
            kept = np.cumsum(mark[:-1]) == 0
            total = np.concatenate([[0], np.cumsum(kept)])
            removed = n - (total[first[1:]] - total[first[:-1]])
            s, e = starts[kept], ends[kept]
            length = e - s + 1
            new = np.concatenate([[0], np.cumsum(length)])
            joined = np.full(new[-1], 0x20, np.uint8)
            inside = np.ones(new[-1], bool)
            inside[new[1:] - 1] = False
            cover = np.zeros(len(data) + 1, np.int8)
            cover[s] += 1
            np.subtract.at(cover, e, 1)
            joined[inside] = data[np.cumsum(cover[:-1], dtype=np.int8) > 0]
            raw = memoryview(joined.tobytes())
            a, b = new[total[first[:-1]]].tolist(), (new[total[first[1:]]] - 1).tolist()
            sha = [hashlib.sha256(raw[x : max(x, y)]).hexdigest() for x, y in zip(a, b, strict=True)]
            extra = [pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(sha, pa.string())]
            if len(made) > len(extra):
                text = part.column(own[0]).to_pylist()
                for i in np.flatnonzero(removed).tolist():
                    # a removed stretch goes from its first word to the next kept word
                    k = kept[first[i] : first[i + 1]]
                    w = np.append(starts[first[i] : first[i + 1]], off[i + 1])
                    base = data[off[i] : off[i + 1]].tobytes()
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], k, [False]]).astype(np.int8)))
                    pieces = [base[w[x] - off[i] : w[y] - off[i]] for x, y in zip(edge[::2], edge[1::2], strict=True)]
                    lead = base[: w[0] - off[i]] if k[0] else b""
                    text[i] = (lead + b"".join(pieces)).decode("utf-8", "replace").rstrip() if not k[-1] else (lead + b"".join(pieces)).decode("utf-8", "replace")
                extra.append(pa.array(text, pa.string()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *extra], [*names, *made])

    return run


def _each_batch(docs: DataFrame, batches: int, window: int, max_runs: int, bits: int, root: str | None, name: str | None, own: list[str]):
    """(batch with its removed windows) for each ascending range of ids; columns as given, and `own`: text and flags.

    A batch counts for those after it when the next one is asked for: its rows must be written by then. A standing index takes
    all batches when the one after the last is asked for.
    """
    spark = docs.sparkSession
    temporary = root is None
    root = root or C.scratch(spark, "index")
    cuts = [i / batches for i in range(1, batches)]
    facts = docs.agg(F.percentile_approx("doc_id", cuts).alias("cuts"), F.sum(F.octet_length("text")).alias("n")).first()
    index = FingerprintIndex(spark, root, max(MIN_BUCKETS, -(-(facts["n"] or 0) // BUCKET_BYTES)), window, max_runs, bits, lasting=not temporary)
    index.expect(name)
    edges = sorted(set(facts["cuts"] or []))
    tests = []
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        t = F.lit(True) if low is None else F.col("doc_id") > low
        t = t & (F.col("doc_id") <= high) if high is not None else t | F.col("doc_id").isNull()
        tests.append(t)
    text, flags_, id_, key_, id2, key2 = [*own, *C.fresh([*docs.columns, *own], "own_id", "own_key", "flag_id", "flag_key")]
    for k, test in enumerate(tests):
        batch = docs.where(test)
        # equal ids with unequal texts are told apart by the text's hash
        found = {id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), key_: F.xxhash64("text"), text: F.coalesce("text", F.lit(""))}
        marked = batch.select("*", *(v.alias(n) for n, v in found.items()))
        asked = marked.select(F.col(id_).alias("id"), F.col(key_).alias("key"), F.col(text).alias("text"))
        flags, done = index.judge(asked, keep=not temporary or k + 1 < len(tests))
        C.release(spark)  # the windows' shuffle is of no more use
        by_doc = flags.where("length(data) > 0").groupBy(F.col("id").alias(id2), F.col("key").alias(key2)).agg(F.collect_list("data").alias(flags_))  # the windows of one text
        yield marked.join(by_doc, (F.col(id_) == F.col(id2)) & (F.col(key_) == F.col(key2)), "left").select(*(F.col(f"`{c}`") for c in docs.columns), text, flags_)
        done(stand=False)
        C.release(spark)
    if temporary:
        C.remove(spark, root)
    else:
        index.stand(name)


def dedup(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, max_runs: int = MAX_RUNS, bits: int = 64, root: str | None = None, with_text: bool = False, name: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and `text` without removed words if asked).

    root: a standing index to judge against and to join; name: what this call is called there.
    """
    spark = docs.sparkSession
    out = C.scratch(spark, "dedup")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", clean string" * with_text
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = ["whole", "flags"]
    for part in _each_batch(rows, batches, window, max_runs, bits, root, name, own):
        part.select("doc_id", *own).mapInArrow(_clean(["doc_id"], window, own, ["n_words", "n_removed", "kept_sha256", "clean"][: 3 + with_text]), schema).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out).withColumnsRenamed({"clean": "text"})


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages are cut from the later documents; a document of which nothing is left goes."""
    out = C.scratch(spark, "cleaned")
    names, schema = docs.columns, docs.schema
    *own, n_words, n_removed, sha, clean = C.fresh(names, "whole", "flags", "n_words", "n_removed", "kept_sha256", "clean")
    full = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, {n_words} long, {n_removed} long, {sha} string, {clean} string"
    for part in _each_batch(docs, BATCHES, WINDOW, MAX_RUNS, 64, None, None, own):
        cleaned = part.mapInArrow(_clean(names, WINDOW, own, [n_words, n_removed, sha, clean]), full).where((F.col(n_removed) == 0) | (F.col(n_removed) < F.col(n_words)))
        text = F.when(F.col("text").isNull(), None).otherwise(F.col(clean))
        new = {"text": text, "n_chars": F.length(text)}
        cleaned.select(*((new[c] if c in new else F.col(f"`{c}`")).cast(schema[c].dataType).alias(c) for c in names)).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM a),
g AS (SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS seq FROM w),
f AS (SELECT doc_id, i, word, i + 13 <= n AND doc_id > min(doc_id) FILTER (WHERE i + 13 <= n) OVER (PARTITION BY seq) AS again FROM g),
r AS (SELECT *, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone FROM f),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT a.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM a LEFT JOIN k ON k.doc_id = a.doc_id
"""
