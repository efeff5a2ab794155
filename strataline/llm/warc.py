"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id into shards whose bounds follow from the pages alone: bytes are summed by range of ids,
ranges of more than the target are cut again, and neighbouring ranges are joined up to it. The target is `shard_bytes`, or a
65,536th of all bytes if that is more. A task writes whole shards, each as gzip members, one per record, and starts a shard's
next file when the compressed size passes `roll_bytes`. Headers are made anew from the content: WARC-Record-ID is derived from page id and
payload digest, WARC-Date is a parameter, both digests are SHA-256, Content-Length counts what is written. Equal payloads of
at least `min_revisit` bytes are written once: the smallest page id is the response, the others are revisits that name it.
Files are written under temporary names and renamed; each task reports its files as manifest rows, and the archive counts as
committed when the manifest stands. The same input gives the same files and bytes, whatever the number of partitions, so a
repeated task overwrites its own result.

Defined results: a null html is an empty payload; a null url is written as an empty target; rows with a null page id are
written with an empty id, are never referred to and stand in shards of their own, first and in order of their digests; the
rows of one page id are never split; repeated rows are written one by one, and of rows with equal
id and payload one is the response (the others revisit its id); an empty table gives an empty manifest; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import common as C

ROLL_BYTES = 64 << 20
#: Bytes of a shard before compression, with HEAD bytes for each record's headers; most shards of an archive.
SHARD_BYTES, HEAD, SHARDS = 32 << 20, 512, 1 << 16
MIN_REVISIT = 100
DATE = "2000-01-01T00:00:00Z"
LEVEL = 6
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
_MANIFEST = "file string, records long, bytes long, sha256 string"


def _escape(url: str) -> str:
    """A header value on one line."""
    return "".join(c if c not in "\r\n%" else f"%{ord(c):02X}" for c in url)


def _unescape(value: str) -> str:
    for code, c in (("%0D", "\r"), ("%0A", "\n"), ("%25", "%")):
        value = value.replace(code, c)
    return value


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit has no block of its own."""
    body = payload if refers is None else b""
    name = "" if page_id is None else str(page_id)
    rid = uuid.uuid5(_NAMESPACE, f"{name}:{digest}:{'response' if refers is None else 'revisit'}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{rid}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_escape(url)}",
        f"WARC-Page-ID: {name}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest() if refers is not None else digest}",
    ]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_NAMESPACE, f'{refers}:{digest}:response')}>", f"WARC-Refers-To-Page-ID: {refers}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)  # a gzip header without time or name
    return z.compress(data) + z.flush()


def _members(blob_stream, size: int = 1 << 20):
    """Decompressed gzip members of a stream, one at a time."""
    rest = b""
    z, out = zlib.decompressobj(31), []
    while True:
        if not rest:
            rest = blob_stream.read(size)
            if not rest:
                if out:
                    raise ValueError("a record is cut short")
                return
        out.append(z.decompress(rest))
        rest = z.unused_data if z.eof else b""
        if z.eof:
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []


def _writer(root: str, roll_bytes: int, date: str, level: int):
    def run(batches):
        state = {"parts": [], "size": 0, "n": 0, "k": 0, "shard": None}

        def close():
            name = f"part-{state['shard']:06d}-{state['k']:05d}.warc.gz"
            C.write_file(f"{root}/{name}", state["parts"])
            h = hashlib.sha256()
            for p in state["parts"]:
                h.update(p)
            row = (name, state["n"], state["size"], h.hexdigest())
            state.update(parts=[], size=0, n=0, k=state["k"] + 1)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["file", "records", "bytes", "sha256"])

        mark, done = None, None
        for b in C.chunks(batches, "html", 4 << 20):
            for shard, page_id, digest, first, url, html in zip(*(b.column(k).to_pylist() for k in ("shard", "page_id", "payload_digest", "first", "url", "html")), strict=True):
                if shard != state["shard"]:
                    if state["n"]:
                        yield close()
                    state.update(shard=shard, k=0)
                own = (page_id, digest)
                if first is not None:  # stands before the rows that it is about
                    mark = (*own, first)
                    continue
                refers = mark[2] if mark and mark[:2] == own else None
                if refers == page_id and done != own:  # of rows with the first id, one alone is the response
                    refers = None
                done = own
                member = _gzip(record(page_id, url or "", (html or "").encode(), digest, refers, date), level)
                state["parts"].append(member)
                state["size"] += len(member)
                state["n"] += 1
                if state["size"] >= roll_bytes:
                    yield close()
        if state["n"]:
            yield close()

    return run


def shard_starts(sizes: DataFrame, target: int) -> list[int]:
    """First page id of each shard, from (page_id, n): all rows of ids from one start to the next make up to `target` bytes,
    unless a single id has more. Sums of bytes by range are all that reaches the driver, a bounded number at a time."""
    low, high = sizes.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return []
    wide = max(0, (high - low).bit_length() - 12)

    def sums(rows: DataFrame, shift: int) -> dict[int, int]:
        return {r["cell"]: r["n"] for r in rows.groupBy(F.shiftright("page_id", shift).alias("cell")).agg(F.sum("n").alias("n")).collect()}

    done: list[tuple[int, int]] = []
    cells, shift = sums(sizes, wide), wide
    while True:
        heavy = [c for c, n in cells.items() if n > target and shift]
        done += [(c << shift, n) for c, n in cells.items() if n <= target or not shift]
        if not heavy:
            break
        step = min(shift, 12, max(1, 19 - len(heavy).bit_length()))
        places = sizes.sparkSession.createDataFrame([(c,) for c in heavy], "cell long")  # at most bytes / target rows
        rows = sizes.join(F.broadcast(places), F.shiftright("page_id", shift) == F.col("cell"), "left_semi")
        cells, shift = sums(rows, shift - step), shift - step
    out, held = [], 0
    for start, n in sorted(done):
        if not out or held + n > target:
            out.append(start)
            held = 0
        held += n
    return out


def with_shard(rows: DataFrame, starts: list[int], null_bits: int | None) -> DataFrame:
    """Rows with the number of their shard: of the last start at or below the page id; null ids go by their digest."""
    first = 0 if null_bits is None else 1 << null_bits
    by_digest = F.shiftright(F.conv(F.substring("payload_digest", 1, 4), 16, 10).cast("int"), 16 - (null_bits or 0))
    if not starts:
        return rows.withColumn("shard", by_digest)
    shift = max(0, (starts[-1] - starts[0]).bit_length() - 12)
    cells: dict[int, list[int]] = {}
    for s in starts:
        cells.setdefault(s >> shift, []).append(s)
    low, number, table = min(cells), 0, []
    for c in range(low, max(cells) + 1):  # at most 4,097 rows, and a number per shard
        table.append((c, number, cells.get(c, [])))
        number += len(cells.get(c, []))
    places = F.broadcast(rows.sparkSession.createDataFrame(table, "cell long, before int, starts array<long>"))
    cell = F.least(F.greatest(F.shiftright("page_id", shift), F.lit(low)), F.lit(max(cells)))
    placed = rows.withColumn("cell", cell).join(places, "cell", "left")
    inside = F.size(F.filter("starts", lambda x: x <= F.col("page_id")))
    return placed.withColumn("shard", F.when(F.col("page_id").isNull(), by_digest).otherwise(F.lit(first) + F.col("before") + inside - 1)).drop("cell", "before", "starts")


def write(pages: DataFrame, root: str, roll_bytes: int = ROLL_BYTES, min_revisit: int = MIN_REVISIT, date: str = DATE, level: int = LEVEL, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the archive under `root`; returns its manifest (file, records, bytes, sha256), which stands as JSON in root/manifest.

    Only ids, sizes and digests are grouped and joined: a page that shares its payload gets a small row with the first page's
    id, which is sorted before it. Payloads are shuffled once, to their shard.
    """
    spark = pages.sparkSession
    ship_package(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha2(F.encode("html", "UTF-8"), 256))
    facts_at = C.scratch(spark, "pages")
    size = F.octet_length("html").cast("long")
    facts = C.materialise(rows.select("page_id", "payload_digest", size.alias("size"), (size + F.coalesce(F.octet_length("url"), F.lit(0)) + HEAD).alias("n")), "pages", facts_at)
    whole = facts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.when(F.col("page_id").isNull(), F.col("n"))).alias("none")).first()
    target = max(shard_bytes, whole["n"] // SHARDS)
    starts = shard_starts(facts.where("page_id is not null"), target)
    null_bits = None if whole["none"] is None else min(16, (whole["none"] // target).bit_length())
    keys = facts.where((F.col("size") >= min_revisit) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    first = keys.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    none = F.lit(None).cast("string")
    marks = keys.distinct().join(first, "payload_digest").select("page_id", none.alias("url"), none.alias("html"), "payload_digest", "first")
    every = with_shard(rows.withColumn("first", F.lit(None).cast("long")).unionByName(marks), starts, null_bits)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(starts) // 8)
    ordered = every.repartition(tasks, "shard").sortWithinPartitions("shard", "page_id", "payload_digest", F.col("first").desc_nulls_last(), F.xxhash64("url", "html"))
    manifest = ordered.mapInArrow(_writer(root, roll_bytes, date, level), _MANIFEST)
    manifest.write.mode("overwrite").json(f"{root}/manifest")
    C.remove(spark, facts_at)
    return spark.read.schema(_MANIFEST).json(f"{root}/manifest")


def parse(member: bytes) -> dict:
    """Headers and body of one record, held against its own length and digest."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(h["Content-Length"])
    body = rest[:n]
    if rest[n:] != b"\r\n\r\n" or h["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(body).hexdigest():
        raise ValueError("a record's block does not fit its headers")
    return h | {"body": body}


def _reader(root: str):
    def run(batches):
        for b in batches:
            for name in b.column("file").to_pylist():
                fs, path = C.filesystem(f"{root}/{name}")
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for m in _members(stream):
                        h = parse(m)
                        page = h["WARC-Page-ID"]
                        refers = h.get("WARC-Refers-To-Page-ID")
                        rows.append((int(page) if page else None, _unescape(h["WARC-Target-URI"]), int(h["WARC-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"], int(refers) if refers else None, h["body"] if refers is None else None))
                        if len(rows) >= 500:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return run


_READ = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ.values(), strict=True)], list(_READ))


def read(spark, root: str) -> DataFrame:
    """The records of an archive: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""
    ship_package(spark)
    files = spark.read.schema(_MANIFEST).json(f"{root}/manifest").select("file")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(parts).mapInArrow(_reader(root), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    root = C.scratch(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), root)
    return read(spark, root).drop("payload", "url")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> low THEN low END AS refers_to
FROM r
"""
