"""Quality rules: counts of whole texts, and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Byte n-grams of every text are hashed into a fixed number of slots. Two multinomials over the slots are counted: the raw
corpus (every document) and the trusted target (documents of the label table with quality 1 and toxic 0, of which at most
`sample` are taken, those with the smallest hash of their id). A document's score is the mean over its n-grams of
log((target + k) / (raw * share + k)); a slot that the target had no fair chance to show stays near zero. A document is
kept if it passes the base rules and its score is at least `threshold`: the same rule for every document, no drawing.

Defined results: a null text is empty (no words: the base rules fail it); a text under n bytes scores 0; a null id is judged
like any other but is never part of the target; repeated rows give repeated results; an empty table gives no rows; without
target documents every score is 0; columns beyond id and text are not read. Labels shape the target alone: a document that is
labelled good and toxic, or bad, is no part of it, but is judged by its text like all others and may be kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import common as C

SLOT_BITS = 18
NGRAM = 4
SAMPLE = 50_000
THRESHOLD = -0.35
PRIOR = 20.0
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS)] = 1


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _repeats(doc: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """For each item: is its (doc, 128-bit digest) found twice or more."""
    if not len(h1):
        return np.zeros(0, bool)
    order = np.lexsort((h1, doc))
    d, a, b = doc[order], h1[order], h2[order]
    if ((d[1:] == d[:-1]) & (a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # equal in the first half alone
        order = np.lexsort((h2, h1, doc))
        d, a, b = doc[order], h1[order], h2[order]
    same = np.zeros(len(a), bool)
    same[1:] = (d[1:] == d[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    same[:-1] |= same[1:]
    out = np.empty(len(a), bool)
    out[order] = same
    return out


def base_counts(data: np.ndarray, off: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """The counts of the base rules for each document of a chunk."""
    n = len(off) - 1
    starts, ends, first = C.words(data, off)
    n_words = np.diff(first)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    np.subtract.at(inside, ends, 1)
    covered = np.cumsum(inside[:-1], dtype=np.int8) > 0
    chars = _sums(covered & ((data & 0xC0) != 0x80), off)
    symbols = _sums(_SYMBOL[data], off)

    raw = data.tobytes()
    dup_lines = np.zeros(n, np.int64)
    for i in np.flatnonzero(_sums(data == 0x0A, off)).tolist():
        lines = [x for x in raw[off[i] : off[i + 1]].split(b"\n") if x and not x.isspace()]
        dup_lines[i] = len(lines) - len(set(lines))

    at = C.window_starts(first, window)
    twice = _repeats(np.searchsorted(first, at, side="right") - 1, *C.window_lanes(C.lanes(data, starts, ends), at, window))
    mark = np.zeros(len(starts) + 1, np.int64)
    np.add.at(mark, at[twice], 1)
    np.subtract.at(mark, at[twice] + window, 1)
    repeat = _sums(np.cumsum(mark[:-1]) > 0, first)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat}


def slots(data: np.ndarray, off: np.ndarray, bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each byte n-gram and the document bounds among them; no n-gram spans two documents."""
    if len(data) < n:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    key = data[: len(data) - n + 1].astype(np.uint32)
    for i in range(1, n):
        key = key * np.uint32(0x01000193) ^ data[i : len(data) - n + 1 + i]
    key = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    ok = np.ones(len(key) + 1, np.int32)
    ok[-1] = 0
    for i in range(1, n):
        at = off[1:] - i
        ok[at[(at >= 0) & (at < len(key))]] = 0
    total = np.concatenate([[0], np.cumsum(ok)])
    return key[ok[:-1] > 0].astype(np.int64), total[np.minimum(off, len(key))]


def _counter(bits: int, n: int):
    def count(batches):
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for part in C.chunks(batches, "text"):
            data, off = C.utf8(part.column("text"))
            key, first = slots(data, off, bits, n)
            raw += np.bincount(key, minlength=1 << bits)
            chosen = np.repeat(part.column("target").to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
            if chosen.any():
                target += np.bincount(key[chosen], minlength=1 << bits)
        used = np.flatnonzero(raw)
        for i in range(0, len(used), 1 << 16):
            u = used[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int32)), pa.array(raw[u]), pa.array(target[u])], ["slot", "raw", "target"])

    return count


def fit(docs: DataFrame, labels: DataFrame, bits: int = SLOT_BITS, n: int = NGRAM, sample: int = SAMPLE, prior: float = PRIOR) -> np.ndarray:
    """log ratio of each slot; counted over every document. Holds 2**bits numbers whatever the input."""
    spark = docs.sparkSession
    ship_package(spark)
    trusted = (
        labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
        .select(F.col("doc_id").alias("_id")).distinct()
        .orderBy(F.xxhash64("_id"), "_id").limit(sample).withColumn("_t", F.lit(True))
    )
    marked = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(trusted), "_id", "left")  # at most `sample` ids
    counts = (
        marked.select("text", F.coalesce("_t", F.lit(False)).alias("target"))
        .mapInArrow(_counter(bits, n), "slot int, raw long, target long")
        .groupBy("slot").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )
    got = counts.toPandas()  # at most 2**bits rows
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[got["slot"]], target[got["slot"]] = got["raw"], got["target"]
    if not target.sum():
        return np.zeros(1 << bits, np.float32)
    return np.log((target + prior) / (raw * (target.sum() / raw.sum()) + prior)).astype(np.float32)


def _judge(model, bits: int, n: int, threshold: float):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batches):
        ratio = model.value
        for part in C.chunks(batches, "text"):
            data, off = C.utf8(part.column("text"))
            got = base_counts(data, off)
            key, first = slots(data, off, bits, n)
            total = np.concatenate([[0], np.cumsum(ratio[key], dtype=np.float64)])
            score = (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)
            failed = (got["n_words"] < 10) | (100 * got["n_repeat_words"] > 20 * got["n_words"])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(got[k].astype(np.int64)) for k in names), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)],
                ["doc_id", *names, "base_failed", "kept", "llr"],
            )

    return judge


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bits: int = SLOT_BITS, n: int = NGRAM, sample: int = SAMPLE, prior: float = PRIOR) -> DataFrame:
    """One row per document: the base counts, base_failed, kept and the length-normalised log ratio llr."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, bits, n, sample, prior))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_judge(model, bits, n, threshold), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return quality(docs, labels).drop("llr")


# the trusted sample is whole here: the SQL is for tables of at most SAMPLE labels
ORACLE_SQL = rf"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM a),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM b),
g AS (SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS seq FROM w),
f AS (SELECT doc_id, i, i + 5 <= n AND count(*) FILTER (WHERE i + 5 <= n) OVER (PARTITION BY doc_id, seq) > 1 AS twice FROM g),
r AS (SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS again FROM f),
p AS (SELECT doc_id, count(*) FILTER (WHERE again) AS n_repeat_words FROM r GROUP BY doc_id),
c AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM b),
x AS (SELECT doc_id, unnest(bs) AS h, unnest(range(len(bs))) AS i FROM (SELECT doc_id, regexp_extract_all(hex(encode(t)), '..') AS bs FROM a)),
y AS (SELECT doc_id, i, ('0x' || h)::BIGINT AS b FROM x),
z AS (SELECT doc_id, b, lead(b, 1) OVER o AS b1, lead(b, 2) OVER o AS b2, lead(b, 3) OVER o AS b3 FROM y WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, CAST(xor(xor(xor(b * 16777619 % 4294967296, b1) * 16777619 % 4294967296, b2) * 16777619 % 4294967296, b3) AS UBIGINT) AS key FROM z WHERE b3 IS NOT NULL),
s AS (SELECT doc_id, (key * 2654435761::UBIGINT) % 4294967296::UBIGINT // {1 << 32 - SLOT_BITS}::UBIGINT AS slot, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0) AS good FROM k),
v AS (SELECT slot, count(*) AS raw, count(*) FILTER (WHERE good) AS target FROM s GROUP BY slot),
u AS (SELECT slot, CASE WHEN sum(target) OVER () = 0 THEN 0 ELSE ln((target + {PRIOR}) / (raw * (sum(target) OVER () / sum(raw) OVER ()) + {PRIOR})) END AS ratio FROM v),
l AS (SELECT doc_id, avg(ratio) AS llr FROM s JOIN u ON u.slot = s.slot GROUP BY doc_id),
e AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed, coalesce(llr, 0) AS llr FROM c LEFT JOIN p ON p.doc_id = c.doc_id LEFT JOIN l ON l.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND llr >= {THRESHOLD} AS kept FROM e
"""
