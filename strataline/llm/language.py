"""Language ID: one interpolated Kneser-Ney character model per language, in sorted hash arrays.

A text becomes a string of symbols: lower-cased letters (code points up to 0x24F stand for themselves, others are hashed
into the rest of 4096 symbols) and one space for each run of other characters, after three spaces of padding. Spark counts
every 4-gram of every training text exactly; continuation counts of orders 3 to 1 are counts of distinct longer n-grams.
An n-gram is keyed by its 12-bit symbols (48 bits at most), so no two share an entry. Tables (language, order) keep all
n-grams; where FLOOR_BITS is set, those that make up at least 2**-FLOOR_BITS of their count, and what the others count goes to
the back-off weight of their context, so that probabilities sum to 1 either way. Executors range-sort all tables and write each
partition's part of a table as sorted arrays to a file in the shared folder; the driver gets a row of figures per part. Workers
map the files where the folder is a file system of the machine, so workers of a host share one copy outside their own memory,
and read them elsewhere.
A text gets the language with the lowest cross-entropy per symbol; ties go to the smaller name.

Rejection is calibrated on one residue of the id hash, scored by models of the other training residues; the models that score
the table then count all training residues, so every labelled document outside the held-out one teaches. For each language the
median cross-entropy of its documents, their spread (from the median absolute deviation) and the variance of blocks give a
bound that widens for short texts. A language with fewer than LEAST_DOCS such documents of LONG symbols is calibrated on its
short ones too; if these are few as well, it gets the bound pooled over the documents of all languages, moved up to the median
of its own documents if that is higher (one half of them under a model of the other, if none count in residue 1). Without
any calibration document the bound is PRIOR; it is never infinite, as one block without a bound would keep any text. Each block of a text counts in its own best language, and the bounds are averaged
alike, so a text that mixes known languages is kept; one above its bound is rejected. `und` is rejected as well.

Defined results: a null text or one without a letter is `und` with score 0; without any training document every text is
`und`; a null lang is not learned from; a null id counts as held out; repeated rows give repeated results; an empty table
gives no rows; columns beyond id, text and lang are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import common as C

#: If set, a table keeps n-grams of at least this share of its count (a power of one half), and so at most as many.
FLOOR_BITS = None
FOLDS = 5
SYMBOL_BITS = 12
PLAIN = 0x250
SPACE = 0x20
SIGMAS = 8.0
#: Least spread between documents of a language, in nats per symbol: a uniform training set must not make the bound tight.
LEAST_SPREAD = 0.1
#: Calibration documents that a bound of a language's own needs, and the symbols from which a document counts as long.
LEAST_DOCS, LONG = 5, 100
#: The bound (median, variance between documents, variance within) where nothing calibrates: half the nats of a uniform symbol.
PRIOR = (0.5 * SYMBOL_BITS * float(np.log(2)), LEAST_SPREAD**2, 0.0)
#: Text bytes that a scan holds at once.
CHUNK = 1 << 20
#: Symbols of a block; for rejection each block of a text counts in the language that suits it best.
BLOCK = 64

_TABLE: list[np.ndarray] = []


def _symbol(cp: int) -> int:
    """4096 symbols: letters as above, SPACE for all else."""
    c = chr(cp)
    if not c.isalpha():
        return SPACE
    low = c.lower()
    v = ord(low) if len(low) == 1 else cp
    return v if v < PLAIN else PLAIN + (v * 0x9E3779B1 >> 7) % ((1 << SYMBOL_BITS) - PLAIN)


def _symbols(cps: np.ndarray) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.fromiter((SPACE if 0xD800 <= c < 0xE000 else _symbol(c) for c in range(0x10000)), np.uint16, 0x10000))
    out = _TABLE[0][np.minimum(cps, 0xFFFF)]
    far = np.flatnonzero(cps > 0xFFFF)
    if len(far):
        u, inverse = np.unique(cps[far], return_inverse=True)
        out[far] = np.array([_symbol(int(c)) for c in u], np.uint16)[inverse]
    return out


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """48-bit 4-gram ending at each symbol; document bounds among them; does a document have a letter."""
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    bounds = lead[off]
    if bounds[-1] != len(cps):  # not valid UTF-8: decode text by text
        parts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(off[:-1], off[1:], strict=True)]
        cps, bounds = np.concatenate([*parts, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    sym = _symbols(cps)
    letter = sym != SPACE
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    starts = bounds[:-1][bounds[:-1] < len(sym)]
    keep[starts] = letter[starts]
    total = np.concatenate([[0], np.cumsum(keep)])
    letters = np.concatenate([[0], np.cumsum(letter)])
    first = total[bounds]
    s = sym[keep].astype(np.uint64)
    begin = first[:-1][np.diff(first) > 0]
    key, before = s.copy(), s
    for k in range(1, 4):
        shifted = np.empty_like(before)
        shifted[1:] = before[:-1]
        shifted[begin] = SPACE
        key |= shifted << np.uint64(SYMBOL_BITS * k)
        before = shifted
    return key.astype(np.int64), first, letters[bounds[1:]] > letters[bounds[:-1]]


def _count(batches):
    for part in C.chunks(batches, "text", CHUNK, "language"):
        data, off = C.utf8(part.column("text"))
        key, first, _ = grams(data, off)
        code = part.column("lang").dictionary_encode()
        lang = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        u, n = np.unique(np.repeat(lang, np.diff(first)) << 48 | key, return_counts=True)
        yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(u >> 48)), pa.array(u & ((1 << 48) - 1)), pa.array(n.astype(np.int64))], ["lang", "k", "c"])


#: Figures beside the keys: counts of n-grams; totals, kept types and dropped counts of contexts.
_FIGURES = {False: ("a",), True: ("a", "b", "e")}


def _write_parts(root: str):
    """The sorted rows of a partition as a file of arrays for each table in it; a row that tells of each."""

    def flush(t, lang, at, held):
        name = f"{t:02d}-{hashlib.sha256(lang.encode()).hexdigest()}-{at:06d}"
        columns = [np.concatenate(c).astype("<i8") for c in zip(*held, strict=True)]
        C.write_file(f"{root}/{name}", [c.tobytes() for c in columns])
        return t, lang, name, len(columns[0]), int(columns[0][0])

    def run(batches):
        at, key, held, done = TaskContext.get().partitionId(), None, [], []
        for b in batches:
            t, code = b.column("t").to_numpy(), b.column("lang").dictionary_encode()
            lang = code.indices.to_numpy()
            cut = np.flatnonzero((t[1:] != t[:-1]) | (lang[1:] != lang[:-1])) + 1
            for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(t)], strict=True):
                if x == y:
                    continue
                own = (int(t[x]), code.dictionary[int(lang[x])].as_py())
                if own != key:
                    if held:
                        done.append(flush(*key, at, held))
                    key, held = own, []
                held.append([b.column(c).to_numpy()[x:y].copy() for c in ("k", *_FIGURES[own[0] >= 10])])
        if held:
            done.append(flush(*key, at, held))
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], ["t", "lang", "name", "n", "low"])

    return run


class Model:
    """Files of sorted arrays by language: counts of n-grams (tables 1 to 4), figures of contexts (11 to 14).

    files: for each table its parts (name, rows, smallest key) by key, and how many rows they have.
    """

    def __init__(self, root: str, files: dict[tuple[int, str], tuple[list, int]], discount: dict[tuple[int, str], float]):
        self.root, self.files, self.discount = root, files, discount
        self.langs, self.bounds = sorted({lang for _, lang in files}), {}

    def _parts(self, t: int, lang: str) -> list[tuple[int, np.ndarray]]:
        """Smallest key, and keys and figures by row, of a table's parts; mapped or read once in each worker."""
        held = C.held("language", self.root, dict)
        if (t, lang) not in held:
            width = 1 + len(_FIGURES[t >= 10])
            held[t, lang] = [(low, C.mapped(f"{self.root}/{name}", "<i8").reshape(width, n)) for name, n, low in self.files.get((t, lang), ([], 0))[0]]
        return held[t, lang]

    def _get(self, t: int, lang: str, key: np.ndarray) -> list[np.ndarray]:
        parts = self._parts(t, lang)
        out = np.zeros((len(_FIGURES[t >= 10]), len(key)))
        part = np.searchsorted([low for low, _ in parts], key, side="right") - 1
        for i, (_, (keys, *figures)) in enumerate(parts):
            on = np.flatnonzero(part == i) if len(parts) > 1 else np.arange(len(key))
            at = np.minimum(np.searchsorted(keys, key[on]), len(keys) - 1)
            hit = keys[at] == key[on]
            for row, x in zip(out, figures, strict=True):
                row[on] = np.where(hit, x[at], 0)
        return list(out)

    def drop(self, spark) -> None:
        """Remove the files; the model is of no use afterwards."""
        C.remove(spark, self.root)

    def log_prob(self, lang: str, key: np.ndarray) -> np.ndarray:
        """Interpolated Kneser-Ney log probability of the last symbol of each 4-gram."""
        p = np.full(len(key), 1.0 / (1 << SYMBOL_BITS))
        for order in range(1, 5):
            gram = key & ((1 << SYMBOL_BITS * order) - 1)
            (count,) = self._get(order, lang, gram)
            total, types, dropped = self._get(10 + order, lang, gram >> SYMBOL_BITS)
            d = self.discount.get((order, lang), 0.5)
            seen = total > 0
            share = np.where(seen, np.maximum(count - d, 0) / np.maximum(total, 1), 0)
            rest = np.where(seen, np.minimum(1.0, (d * types + dropped) / np.maximum(total, 1)), 1)
            p = np.minimum(1.0, share + rest * p)
        return np.log(np.maximum(p, 1e-12))


def fit(docs: DataFrame) -> Model:
    """Models from (text, lang) rows; every row counts."""
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    path = C.scratch(spark, "grams")
    full = C.materialise(rows.mapInArrow(_count, "lang string, k long, c long").groupBy("lang", "k").agg(F.sum("c").alias("c")), "grams", path)
    cut = lambda n: F.col("k").bitwiseAND((1 << SYMBOL_BITS * n) - 1)
    level = {4: full}
    for n in (3, 2, 1):
        level[n] = level[n + 1].groupBy("lang", cut(n).alias("k")).agg(F.count("*").alias("c"))
    every = level[4].select(F.lit(4).alias("t"), "lang", "k", "c")
    for n in (3, 2, 1):
        every = every.unionByName(level[n].select(F.lit(n).alias("t"), "lang", "k", "c"))
    grams_path, root = C.scratch(spark, "tables"), C.scratch(spark, "model")
    every = C.materialise(every, "tables", grams_path)
    totals = every.groupBy("t", "lang").agg(F.sum("c").alias("total"), F.sum((F.col("c") == 1).cast("long")).alias("ones"), F.sum((F.col("c") == 2).cast("long")).alias("twos"))
    facts = {(r["t"], r["lang"]): r for r in totals.collect()}  # four rows a language
    kept, met = F.lit(True), every
    if FLOOR_BITS is not None:
        met = every.join(F.broadcast(totals.select("t", "lang", "total")), ["t", "lang"])
        kept = F.col("c") * (1 << FLOOR_BITS) >= F.col("total")
    zero = F.lit(0).cast("long")
    contexts = met.groupBy((F.col("t") + 10).alias("t"), "lang", F.shiftright("k", SYMBOL_BITS).alias("k")).agg(
        F.sum("c").alias("a"), F.sum(kept.cast("long")).alias("b"), F.sum(F.when(~kept, F.col("c")).otherwise(0)).alias("e")
    ).where("b > 0")  # a context of which nothing is kept tells as little as one not seen
    tables = met.where(kept).select("t", "lang", "k", F.col("c").alias("a"), zero.alias("b"), zero.alias("e")).unionByName(contexts)
    order = ["t", "lang", "k"]
    ranged = tables.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    files: dict[tuple[int, str], tuple[list, int]] = {}
    for r in sorted(ranged.mapInArrow(_write_parts(root), "t int, lang string, name string, n long, low long").collect(), key=lambda r: r["low"]):  # a row per part
        parts, n = files.get((r["t"], r["lang"]), ([], 0))
        files[r["t"], r["lang"]] = ([*parts, (r["name"], r["n"], r["low"])], n + r["n"])
    C.remove(spark, path)
    C.remove(spark, grams_path)
    return Model(root, files, {x: min(0.95, max(0.1, r["ones"] / (r["ones"] + 2 * r["twos"]))) if r["ones"] else 0.5 for x, r in facts.items()})


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the stretches between bounds, each by itself."""
    out, on = np.zeros(len(bounds) - 1), np.flatnonzero(np.diff(bounds) > 0)
    if len(on):
        out[on] = np.add.reduceat(values, bounds[on])
    return out


def _score(model):
    names = ["doc_id", "held_out", "lang_pred", "score", "rejected", "ce", "n_symbols", "m2"]

    def score(batches):
        m = model.value
        k = len(m.langs)
        for part in C.chunks(batches, "text", CHUNK, "language"):
            data, off = C.utf8(part.column("text"))
            key, first, letter = grams(data, off)
            n = np.diff(first)
            u, inverse = np.unique(key, return_inverse=True)
            blocks = -(-n // BLOCK)
            doc = np.repeat(np.arange(len(n)), blocks)
            start = first[doc] + BLOCK * (np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
            end = np.minimum(start + BLOCK, first[doc + 1])
            sums, block = np.zeros((len(n), k)), np.zeros((len(doc), k))
            m2 = np.zeros(len(n))
            for j, lang in enumerate(m.langs):
                logs = m.log_prob(lang, u)[inverse]
                sums[:, j], block[:, j] = _sums(logs, first), _sums(logs, np.append(start, first[-1]))
            ok = letter & (k > 0)
            row = np.arange(len(n))
            if k:
                ce = -sums / np.maximum(n, 1)[:, None]
                best = ce.argmin(axis=1)
                gap = (ce - ce[row, best][:, None]) * np.minimum(n, 50)[:, None]
                sure = 1 / np.exp(-gap).sum(axis=1)
                own_lang, size = block.argmax(axis=1), end - start
                value = -block[np.arange(len(doc)), own_lang]
                own = np.bincount(doc, value, len(n)) / np.maximum(n, 1)
                m2 = (np.bincount(doc, value * value / np.maximum(size, 1), len(n)) - n * own * own) / np.maximum(blocks, 1)
                limits = np.array([m.bounds.get(lang, PRIOR) for lang in m.langs])
                share = np.bincount(doc, size * limits[own_lang, 0], len(n)) / np.maximum(n, 1)
                between, within = (np.bincount(doc, size * limits[own_lang, i], len(n)) / np.maximum(n, 1) for i in (1, 2))
                rejected = ~ok | (own > share + SIGMAS * np.sqrt(between + within / np.maximum(n, 1)))
            else:
                best = np.zeros(len(n), np.int64)
                sure, own, rejected = np.zeros(len(n)), np.zeros(len(n)), np.ones(len(n), bool)
            labels = np.array([*m.langs, "und"], object)[np.where(ok, best, k)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(labels, pa.string()), pa.array(np.where(ok, sure, 0.0)), pa.array(rejected), pa.array(own), pa.array(n.astype(np.int64)), pa.array(m2)], names
            )

    return score


def _fold(column) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(column.cast("string")), F.lit(FOLDS)), F.lit(0))


def train(docs: DataFrame) -> Model:
    """Models from the documents whose id hash is not 0 modulo FOLDS; their bounds from residue 1 under models of the others."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), _fold(F.col("doc_id")).alias("fold"))
    path = C.scratch(docs.sparkSession, "calibration")
    first = fit(rows.where("fold > 1"))
    scored = _calibrate(rows.where("fold = 1"), first, path)
    first.drop(docs.sparkSession)
    model = fit(rows.where("fold > 0"))
    model.bounds = _bounds(rows, scored, model.langs)
    C.remove(docs.sparkSession, path)
    return model


def _calibrate(rows: DataFrame, model: Model, path: str) -> DataFrame:
    """Figures of labelled documents under a model: lang_pred, ce, n_symbols, m2, and is the label the prediction (own)."""
    spark = rows.sparkSession
    rows = rows.where("lang is not null and text is not null").select(F.col("lang").alias("doc_id"), F.lit(False).alias("held_out"), "text")
    sent = spark.sparkContext.broadcast(model)  # names of files, discounts and bounds
    scored = rows.mapInArrow(_score(sent), _SCORED.replace("doc_id long", "doc_id string")).where("lang_pred <> 'und'")
    done = C.materialise(scored.select("lang_pred", "ce", "n_symbols", "m2", (F.col("doc_id") == F.col("lang_pred")).alias("own")), "calibration", path)
    return done


def _spreads(scored: DataFrame, by: str) -> dict:
    """Documents, bound, and the variance of a symbol that the documents' own deviations show (for those of one block), by group."""
    mid = scored.groupBy(by).agg(F.percentile_approx("ce", 0.5, 10000).alias("mid"), F.avg("m2").alias("within"), F.count("*").alias("n"))
    spread = scored.join(F.broadcast(mid), by).groupBy(by, "mid", "within", "n").agg(F.percentile_approx(F.abs(F.col("ce") - F.col("mid")), 0.5, 10000).alias("mad"), F.percentile_approx(F.col("n_symbols") * (F.col("ce") - F.col("mid")) ** 2, 0.5, 10000).alias("symbol"))  # a row a language
    return {r[by]: (r["n"], (r["mid"], max(1.4826 * r["mad"], LEAST_SPREAD) ** 2, max(r["within"], 0.0)), 1.4826**2 * r["symbol"]) for r in spread.collect()}


def _bounds(rows: DataFrame, scored: DataFrame, langs: list[str]) -> dict[str, tuple[float, float, float]]:
    """A finite bound for each of the languages, from documents that the model they are scored by has not seen."""
    spark = rows.sparkSession
    path = C.scratch(spark, "calibration")
    long = _spreads(scored.where(F.col("n_symbols") >= LONG), "lang_pred")
    bounds = {lang: long[lang][1] for lang in langs if lang in long and long[lang][0] >= LEAST_DOCS}
    rare = [lang for lang in langs if lang not in bounds]
    if rare:
        right = scored.where("own").withColumn("every", F.lit(0))
        every = _spreads(right.where(F.col("n_symbols") >= LONG), "every") or _spreads(right, "every")
        pooled = every[0][1] if every else PRIOR
        few = _spreads(right.where(F.col("lang_pred").isin(rare)), "lang_pred")
        if none := [lang for lang in rare if lang not in few]:
            own = rows.where(F.col("lang").isin(none) & (F.col("fold") > 0)).withColumn("half", F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)))
            half = fit(own.where("half = 1"))
            few |= _spreads(_calibrate(own.where("half = 0"), half, path).where("own"), "lang_pred")
            half.drop(spark)
        for lang in rare:
            n, (mid, between, within), symbol = few.get(lang, (0, pooled, 0.0))
            bounds[lang] = (mid, between, max(within, symbol, pooled[2])) if n >= LEAST_DOCS else (max(mid, pooled[0]), *pooled[1:])
    C.remove(spark, path)
    return bounds


_SCORED = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, ce double, n_symbols long, m2 double"


def _apply(rows: DataFrame, sent) -> DataFrame:
    return rows.select("doc_id", "held_out", "text").mapInArrow(_score(sent), _SCORED)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected, ce (nats per symbol) and n_symbols."""
    model = model or train(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (_fold(F.col("doc_id")) == 0).alias("held_out"), "text")
    return _apply(rows, sent).drop("m2")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are rejected go; columns stay."""
    sent = spark.sparkContext.broadcast(train(docs))
    names = docs.columns

    def keep(batches):
        score = _score(sent)
        for part in C.chunks(batches, "text", CHUNK, "language"):
            flat = pa.RecordBatch.from_arrays([pa.nulls(part.num_rows, pa.int64()), pa.nulls(part.num_rows, pa.bool_()), part.column("text")], ["doc_id", "held_out", "text"])
            rejected = np.concatenate([b.column("rejected").to_numpy(zero_copy_only=False) for b in score(iter([flat]))])
            yield pa.RecordBatch.from_arrays(part.columns, names).filter(pa.array(~rejected))

    return docs.mapInArrow(keep, docs.schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")
