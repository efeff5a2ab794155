"""Shared folders, lineage cuts and vectorised scanning of UTF-8 text."""

from __future__ import annotations

import ctypes
import hashlib
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..sources.files import materialise, scratch, shared_root  # noqa: F401  (operators take them from here)

#: Text bytes that one step of a vectorised scan holds at once (a longer text is a step of its own).
CHUNK_BYTES = 2 << 20
#: Odd multipliers of the hashes (fixed values).
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
U64 = np.uint64


# ---------------------------------------------------------------- folders


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names for columns of our own that none of `columns` has, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return [x.getPath().getName() for x in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files whose plans are no longer referenced.

    The listener bus holds on to the last query until the next one, so an empty one is run first.
    """
    import gc

    gc.collect()
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()


# ---------------------------------------------------------------- batches


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(off) == 0:
        off = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


_HELD: dict[tuple, object] = {}


def held(kind: str, key, make):
    """What make() gives, kept by this worker until a task of another kind comes."""
    if (kind, key) not in _HELD:
        _HELD.clear()
        _HELD[kind, key] = make()
    return _HELD[kind, key]


def trim(kind: str | None = None) -> None:
    """Hand unused memory back to the machine: workers are shared by all operators of an application. Keeps what `kind` holds."""
    if any(k != kind for k, _ in _HELD):
        _HELD.clear()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES, kind: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each part holds about `limit` bytes of `column`; whole rows only.

    A task's memory is handed back before and after; kind: whose held objects stay.
    """
    trim(kind)
    yield from _cut(batches, column, limit)
    trim(kind)


def _cut(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, off = utf8(batch.column(column))
        start = 0
        while start < n:
            end = int(np.searchsorted(off, off[start] + limit, side="left"))
            end = min(n, max(end, start + 1))
            yield batch.slice(start, end - start)
            start = end


# ---------------------------------------------------------------- hashes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def remix(x: np.ndarray) -> np.ndarray:
    """Another bijective finaliser of 64-bit values, with other shifts and multipliers."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


#: Bytes of a span that lanes() mixes itself; longer spans go through BLAKE2b.
SHORT = 32
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the bytes data[start:end], together a digest of 128 bits.

    Eight bytes at a time are mixed into each lane by a bijective, non-linear step of its own, so neither lane has the
    algebraic collisions of a polynomial, and the two do not fail together. Spans of more than SHORT bytes get a BLAKE2b digest.
    """
    size = ends - starts
    buf = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    a = size.astype(U64) * U64(MULTIPLIERS[0]) + U64(MULTIPLIERS[1])
    b = size.astype(U64) * U64(MULTIPLIERS[2]) + U64(MULTIPLIERS[3])
    for k in range(0, SHORT, 8):
        on = np.flatnonzero((size > k) & (size <= SHORT))
        if not len(on):
            break
        item = wide[starts[on] + k] & _MASKS[np.minimum(size[on] - k, 8)]
        a[on] = mix(a[on] ^ item)
        b[on] = remix(b[on] + item * U64(MULTIPLIERS[1]))
    far = np.flatnonzero(size > SHORT)
    if len(far):
        raw = memoryview(np.ascontiguousarray(data))
        digest = b"".join([hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(starts[far].tolist(), ends[far].tolist(), strict=True)])
        a[far], b[far] = np.frombuffer(digest, "<u8").reshape(-1, 2).T
    return a, b


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes data[start:end] of each span: the first lane of its digest."""
    return lanes(data, starts, ends)[0]


def window_lanes(items: tuple[np.ndarray, np.ndarray], at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The digest lanes of `size` consecutive items from each place of `at`, from those of the items.

    Neighbours are joined pairwise up a tree (1, 2, 4, ... items); each join ends in a bijective mix.
    """
    out = []
    for lane, join, odd in zip(items, (mix, remix), MULTIPLIERS[1:3], strict=True):
        whole, done, level, n = None, 0, lane, 1
        while True:
            if size & n:
                part = level[at + done]
                whole = part if whole is None else join(whole * U64(odd) + part)
                done += n
            if done == size:
                break
            level = join(level[:-n] * U64(odd) + level[n:]) if len(level) > n else level[:0]
            n *= 2
        out.append(join(whole + U64(size)))
    return out[0], out[1]


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first word number per document (len(off) values) of the words `[^\\x20\\x09-\\x0D]+`."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~_SEPARATOR[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cut = off[1:-1]
    cut = cut[cut < len(data)]
    before[cut] = False  # a document's first byte never continues a word
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the words at which a window of `size` words of one document starts."""
    n = int(first[-1])
    if n < size:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    for_each = np.maximum(first[1:] - (size - 1), first[:-1])
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, for_each, 1)
    np.add.at(mark, first[1:], -1)
    ok &= np.cumsum(mark[:-1]) == 0
    return np.flatnonzero(ok)


# ---------------------------------------------------------------- packed numbers and shared files


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    v = np.ascontiguousarray(values)
    planes = v.view(np.uint8).reshape(-1, v.dtype.itemsize).T.tobytes() if len(v) else b""
    return pa.compress(planes, codec="zstd", asbytes=True)


def expand(blob: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).ravel() if n else np.zeros(0, dtype)


def filesystem(uri: str):
    """A pyarrow file system and the path in it; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_file(uri: str, parts) -> int:
    """Write under a temporary name in the same folder, then rename: readers see whole files only. Returns the size."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path.rpartition('/')[0]}/.{path.rpartition('/')[2]}.{uuid.uuid4().hex}.tmp"
    size = 0
    with fs.open_output_stream(temporary) as out:
        for p in parts:
            out.write(p)
            size += len(p)
    fs.move(temporary, path)
    return size


def read_file(uri: str) -> bytes | None:
    """Content of a shared file, or None if there is none."""
    fs, path = filesystem(uri)
    try:
        with fs.open_input_file(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


def mapped(uri: str, dtype) -> np.ndarray:
    """A shared file as an array: mapped where it lies in the machine's file system, else read."""
    fs, path = filesystem(uri)
    if fs.type_name == "local":
        return np.memmap(path, dtype, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)
