"""Best-fit packing of whole documents, improved by exchanges between bins.

Each document is tokenised whole and ended by one id; only one longer than a sequence is cut, into pieces of a sequence's
length. What fits together depends on lengths alone, so the packing is planned for the histogram of lengths, whose size is the
sequence length and not the corpus: bins with the same lengths in them are one class with a multiplicity. Best-fit decreasing
makes the classes (at most two new ones for each length and each class used up, some 20,000 for 4,096 lengths whatever the
number of documents). A local search then moves a piece from one underfull bin to another, or exchanges one for one or two for
one, on as many equal pairs of bins at once as there are; it takes what leaves the least room and only what increases the sum
of squared fills, so that bins fill up and others empty, and ends when nothing does, or after `steps` exchanges. On Spark,
pieces are ranked by length over range partitions, and a rank gives the sequence and the place in it.

Defined results: a null text is empty (its one id is the end id); a null id stays null; repeated rows are packed one by one;
an empty table gives no rows; columns beyond id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import rank_all
from ..session import ship_package
from . import common as C
from .packing import default_vocabulary, word_tokenizer

LENGTH, END_ID = 4096, 1
#: Exchanges of the local search, each on all equal pairs of bins at once; the packing is whole after any number.
STEPS = 8_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- the plan, from counts of lengths


def best_fit(counts: dict[int, int], size: int) -> dict[tuple, int]:
    """Best-fit decreasing over counts of lengths: classes, as sorted tuples of (length, how many), and their multiplicities."""
    closed: dict[tuple, int] = defaultdict(int)
    rooms: dict[int, list] = defaultdict(list)  # free room -> open classes [items, bins]
    bits = 0  # bit r: rooms[r] is not empty

    def put(room: int, items: tuple, bins: int) -> None:
        nonlocal bits
        if room:
            rooms[room].append([items, bins])
            bits |= 1 << room
        else:
            closed[items] += bins

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            fits = bits >> s
            if not fits:
                each = size // s
                if n // each:
                    put(size - each * s, ((s, each),), n // each)
                if n % each:
                    put(size - n % each * s, ((s, n % each),), 1)
                break
            room = s + (fits & -fits).bit_length() - 1
            items, bins = rooms[room].pop()
            if not rooms[room]:
                bits &= ~(1 << room)
            each = room // s
            full = min(bins, n // each)
            n -= full * each
            bins -= full
            if bins and n:  # the last one takes what is left
                put(room - n * s, (*items, (s, n)), 1)
                n, bins = 0, bins - 1
            if bins:
                put(room, items, bins)
            if full:
                put(room - each * s, (*items, (s, each)), full)
    for room, classes in rooms.items():
        for items, bins in classes:
            closed[items] += bins
    return dict(closed)


def fill(items: tuple) -> int:
    return sum(s * n for s, n in items)


def changed(items: tuple, out, into) -> tuple:
    """A class's items without those of `out` and with those of `into`."""
    held = dict(items)
    for s in out:
        held[s] -= 1
    for s in into:
        held[s] = held.get(s, 0) + 1
    return tuple(sorted(((s, n) for s, n in held.items() if n), reverse=True))


class Search:
    """Classes of underfull bins, and which of them hold a length, or two lengths of a given sum."""

    def __init__(self, classes: dict[tuple, int], size: int):
        self.size, self.bins, self.full = size, {}, defaultdict(int)
        self.holders: tuple[dict, dict] = (defaultdict(dict), defaultdict(dict))  # of one, of two: sum -> class -> lengths
        self.bits = [0, 0]
        for items, n in classes.items():
            self.add(tuple(sorted(items, reverse=True)), n)

    def gifts(self, items: tuple, k: int):
        """The lengths, or pairs of lengths, that a bin can give."""
        if k == 0:
            return [(s,) for s, _ in items]
        held = dict(items)
        return [p for p in combinations_with_replacement(held, 2) if p[0] != p[1] or held[p[0]] > 1]

    def add(self, items: tuple, n: int) -> None:
        if not items or not n:
            return  # empty bins are gone
        if fill(items) == self.size:
            self.full[items] += n
        elif items in self.bins:
            self.bins[items] += n
        else:
            self.bins[items] = n
            for k in (0, 1):
                for g in self.gifts(items, k):
                    self.holders[k][sum(g)][items] = g
                    self.bits[k] |= 1 << sum(g)

    def take(self, items: tuple, n: int) -> None:
        self.bins[items] -= n
        if self.bins[items]:
            return
        del self.bins[items]
        for k in (0, 1):
            for g in self.gifts(items, k):
                of = self.holders[k][sum(g)]
                of.pop(items, None)
                if not of:
                    self.bits[k] &= ~(1 << sum(g))

    def best(self, items: tuple):
        """(growth, given, taken, donor): the exchange that leaves this bin the least room, with the emptiest donor."""
        have, found = fill(items), None
        room = self.size - have
        offers = [((), 0), *((g, 0) for g in self.gifts(items, 0)), *((g, 1) for g in self.gifts(items, 0)), *((g, 0) for g in self.gifts(items, 1))]
        for given, k in offers:
            low = sum(given)
            top = low + room
            while True:
                y = (self.bits[k] & ((1 << (top + 1)) - 1)).bit_length() - 1
                if y <= low or found and y - low <= found[0]:
                    break
                donors = [(fill(d), d) for d in self.holders[k][y] if fill(d) < have + y - low and (d != items or self.bins[d] > 1)]
                if donors:
                    donor = min(donors)[1]
                    found = (y - low, given, self.holders[k][y][donor], donor)
                    break
                top = y - 1
            if found and found[0] == room:
                break
        return found

    def run(self, steps: int) -> dict[tuple, int]:
        """Fill the fullest bins first; passes over all classes until one finds nothing, or `steps` exchanges."""
        again = True
        while steps and again:  # until a pass over all classes finds nothing
            again = False
            order = sorted(self.bins, key=lambda c: (fill(c), c))
            while steps and order:
                items = order.pop()
                found = self.best(items) if items in self.bins else None
                if found is None:
                    continue
                _, given, taken, donor = found
                n = self.bins[items] // 2 if donor == items else min(self.bins[items], self.bins[donor])
                self.take(items, n)
                self.take(donor, n)
                new = changed(items, given, taken), changed(donor, taken, given)
                order += sorted((c for c in {items, donor, *new} if c and fill(c) < self.size), key=lambda c: (fill(c), c))
                for c in new:
                    self.add(c, n)
                steps, again = steps - 1, True
        out = defaultdict(int, self.full)
        for items, n in self.bins.items():
            out[items] += n
        return dict(out)


def plan(counts: dict[int, int], size: int = LENGTH, steps: int = STEPS) -> dict[tuple, int]:
    """Classes of bins and their multiplicities for the counts of lengths."""
    return Search(best_fit(counts, size), size).run(steps)


def slots(classes: dict[tuple, int], counts: dict[int, int]) -> np.ndarray:
    """Rows (first rank, first sequence, pieces per sequence, offset of the first, length) of runs of pieces, by rank.

    Ranks go by length over all pieces; a class's bins are numbered in a row.
    """
    at, below = {}, 0
    for s in sorted(counts):
        at[s] = below
        below += counts[s]
    rows, sequence = [], 0
    for items in sorted(classes, reverse=True):
        offset = 0
        for s, n in items:
            rows.append((at[s], sequence, n, offset, s))
            at[s] += n * classes[items]
            offset += s * n
        sequence += classes[items]
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# ---------------------------------------------------------------- pieces and their places


def _cut(sent, length: int, end_id: int, with_ids: bool):
    def run(batches):
        C.trim("words")
        tok, end = word_tokenizer(sent.value), np.array([end_id], "<u2").tobytes()
        for part in C.chunks(batches, "text", kind="words"):
            data, off = C.utf8(part.column("text"))
            raw = data.tobytes()
            row, piece, size, crc, ids = [], [], [], [], []
            for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                wide = np.frombuffer(tok.encode(raw[a:b]) + end, "<u2").astype("<u4")
                for p in range(0, len(wide), length):
                    own = wide[p : p + length]
                    row.append(k)
                    piece.append(p // length)
                    size.append(len(own))
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        ids.append(own.tobytes())
            n = np.array(piece, np.int64)
            columns = [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(n * length), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.binary())] if with_ids else [])], names + ["ids"] * with_ids)

    return run


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and its ids (little-endian, four bytes each) if asked for."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())  # a vocabulary file, a few MB
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cut(sent, length, end_id, with_ids), PIECE + ", ids binary" * with_ids)


def place(table: DataFrame, size: int = LENGTH, steps: int = STEPS) -> DataFrame:
    """A written table of pieces (`length` from 1 to size, any further columns) with sequence_id and offset."""
    spark = table.sparkSession
    ship_package(spark)
    counts = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}  # a row per length, at most `size`
    sent = spark.sparkContext.broadcast(slots(plan(counts, size, steps), counts))  # a row per length and class of bins
    order = ["length", *(c for c in table.columns if c not in ("length", "ids"))]
    ranked = rank_all(table, order, "rank")
    fields = [f for f in ranked.schema.fields if f.name != "rank"]

    def run(batches):
        runs = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            rank = b.column("rank").to_numpy()
            first, sequence, each, offset, length = runs[np.searchsorted(runs[:, 0], rank, side="right") - 1].T
            own = rank - first
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), pa.array(sequence + own // each), pa.array(offset + own % each * length)], [*(f.name for f in fields), "sequence_id", "offset"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return ranked.mapInArrow(run, f"{out}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, steps: int = STEPS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(C.materialise(pieces(docs, vocabulary, length, end_id), "pieces"), length, steps)


def sequences(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, steps: int = STEPS) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, ids (little-endian, four bytes each), and the pieces in them by offset."""
    table = C.materialise(pieces(docs, vocabulary, length, end_id, True).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed = place(table.drop("ids"), length, steps).select("uid", "sequence_id", "offset")
    item = F.struct("offset", "doc_id", "piece", "length", "ids")
    held = table.join(placed, "uid").groupBy("sequence_id").agg(F.array_sort(F.collect_list(item)).alias("held"))  # at most `length` ids
    return held.select(
        "sequence_id",
        F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("n_tokens"),
        F.aggregate("held", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"),
        F.transform("held", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"))).alias("pieces"),
    )


def op13_bestfit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_vocabulary())
