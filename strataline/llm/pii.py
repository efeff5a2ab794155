"""Personal data: base patterns, and bootstrapped contextual extraction on top of them.

Base spans follow fixed patterns of four kinds (see KINDS), leftmost and non-overlapping per kind. They are the seeds.
Looser shapes of each kind (an address without a dotted domain or with `(at)`, digit groups without a plus, card-like digits
that fail the check digit, colon-separated hexadecimal groups) are candidates that only context can confirm.

Patterns are lexical: the one and the two words before a span. Spark scores the bipartite graph of patterns and instances in
rounds. A pattern's confidence for a kind is the sum of the reliabilities of what fills its slot, over all occurrences of
its words in the corpus, whatever follows them. These are counted exactly, by 64-bit hash, in a second pass over every text,
for the patterns of at least `support` distinct fillers (no other can be accepted). A bitmap of their hashes, of a fixed
size, keeps most other words out of the shuffle; the join after it decides, so the bitmap's collisions change nothing.
An instance's reliability is 1 for seeds, else 1 - prod(1 - confidence) over its patterns. Patterns of at least `support`
distinct reliable fillers and `confidence` accept the candidates in their slots; those become added spans.

Where personal data stands among unrelated words there is no pattern to learn, and the base spans are all that is reported.

Defined results: a null text is empty; a null id gets a row of its own; repeated rows get repeated results (their contexts
count each time); an empty table gives no rows; spans never overlap base spans of any kind if added; the operator reads id
and text only, and the stage keeps all columns of its input, with spans replaced by their kind in brackets.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import common as C

#: The kinds, in the order that ties follow.
KINDS = ("email", "ip", "card", "phone")
ROUNDS, SUPPORT, CONFIDENCE = 3, 5, 0.5
#: Bits of a pattern's hash that number its bit in the bitmap of the counting pass (4 MB).
SLOT_BITS = 25
#: Different contexts that a counting task holds before it hands them on.
HELD_CONTEXTS = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# started only where a run of digits starts: a match inside a run would have started earlier
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = {
    "email": re.compile(r"(?<![^\s<(\[\"',;:])[A-Za-z0-9._%+-]{1,64}\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9.-]{1,255}"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+])\(?[0-9](?:[\x20().\/-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain, leftmost first, in time linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_byte, m.group().split(".")))]
    for m in _CARD.finditer(text):
        d = _digits(m.group()) if m.end() - m.start() >= 14 else ""
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of looser shape that touch no base span and not each other (kinds in order)."""
    taken, out = sorted((s, e) for s, _, e in base), []
    for k, kind in enumerate(KINDS):
        reach = list(accumulate((e for _, e in taken), max))  # the furthest end so far
        new = []
        for m in _LOOSE[kind].finditer(text):
            s, e = m.span()
            before = bisect_left(taken, (e,))  # those that start before this ends
            if not before or reach[before - 1] <= s:
                new.append((s, e))
                out.append((s, k, e))
        taken = sorted(taken + new)
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


_FIELDS = {"t": pa.int32(), "id": pa.int64(), "key": pa.int64(), "kind": pa.int32(), "pattern": pa.int64(), "instance": pa.int64(), "n": pa.int64(), "start": pa.int64(), "end": pa.int64(), "spans": pa.string(), "counts": pa.list_(pa.int64())}
_SCHEMA = "t int, id long, key long, kind int, pattern long, instance long, n long, start long, end long, spans string, counts array<long>"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_MARK = np.zeros(256, bool)
_MARK[list(b"@+0123456789")] = True
_MARK_AT = np.zeros(256, bool)
_MARK_AT[list(b"([")] = True


def _rows(**columns):
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[k].cast(t) if isinstance(columns.get(k), pa.Array) else pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in _FIELDS.items()], list(_FIELDS))


def _contexts(low: np.ndarray, off: np.ndarray):
    """Words (starts, first number per document), and the pattern keys of each word and of each pair with the next word."""
    starts, ends, first = C.words(low, off)
    word = C.span_hashes(low, starts, ends)
    one = C.mix(word + np.uint64(1))
    two = C.mix(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:] + np.uint64(2)) if len(word) > 1 else np.zeros(0, np.uint64)
    return starts, first, one, two


def _scan(batches):
    """Rows of type 0: a document's base spans; 1: an occurrence of pattern and instance."""
    for part in C.chunks(batches, "text"):
        data, off = C.utf8(part.column("text"))
        starts, first, one, two = _contexts(_LOWER[data], off)
        total = np.concatenate([[0], np.cumsum(_MARK[data] | _MARK_AT[data])])
        ids, keys = part.column("id"), part.column("key")
        key_values = keys.to_numpy()
        n = len(off) - 1
        spans, counts = [""] * n, [[0, 0, 0, 0]] * n
        found = []
        for i in np.flatnonzero(total[off[1:]] > total[off[:-1]]).tolist():
            text = data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")
            base = base_spans(text)
            loose = loose_spans(text, base)
            if base:
                spans[i], counts[i] = joined(base), np.bincount([k for _, k, _ in base], minlength=4).tolist()
            done = at = 0
            for s, k, e, seed in sorted([(*x, True) for x in base] + [(*x, False) for x in loose]):
                at, done = at + len(text[done:s].encode()), s
                found.append((i, off[i] + at, k, s, e, seed, int.from_bytes(hashlib.blake2b(f"{k}:{text[s:e]}".encode(), digest_size=8).digest(), "little", signed=True)))
        yield _rows(t=[0] * n, id=ids, key=keys, spans=spans, counts=counts)
        if found:
            doc, at, kind, s, e, seed, inst = (np.array(x) for x in zip(*found, strict=True))
            w = np.searchsorted(starts, at, side="right") - 1
            for back, value in ((1, one), (2, two)):
                ok = np.flatnonzero(w - back >= first[doc])
                if not len(ok):
                    continue
                p = value[w[ok] - back]
                yield _rows(t=[1] * len(ok), id=ids.take(pa.array(doc[ok])), key=key_values[doc[ok]], kind=kind[ok].astype(np.int32), pattern=p.view(np.int64), instance=inst[ok].astype(np.int64), n=seed[ok].astype(np.int64), start=s[ok], end=e[ok])


def _count(bitmap):
    """Counts of the words and pairs whose bit is set (a pattern may come in several rows)."""

    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        shift = np.uint64(64 - (8 * len(bits)).bit_length() + 1)
        keys, counts, held = [], [], 0

        def merged():
            u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.zeros(len(u), np.int64)
            np.add.at(n, inverse, np.concatenate(counts))
            return u, n

        for part in C.chunks(batches, "text"):
            data, off = C.utf8(part.column("text"))
            _, first, one, two = _contexts(_LOWER[data], off)
            inner = np.ones(len(two), bool)
            across = first[1:-1] - 1  # a pair does not cross documents
            inner[across[(across >= 0) & (across < len(two))]] = False
            for value in (one, two[inner]):
                slot = value >> shift
                hit = value[bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1]
                u, n = np.unique(hit, return_counts=True)
                keys.append(u)
                counts.append(n)
                held += len(u)
            if held > HELD_CONTEXTS:
                u, n = merged()
                if len(u) > HELD_CONTEXTS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["pattern", "n"])
                    u, n = u[:0], n[:0]
                keys, counts, held = [u], [n], len(u)
        if held:
            u, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["pattern", "n"])

    return run


def context_totals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often the words of each of `patterns` (distinct, long) occur in the texts, exactly."""
    slot = F.shiftrightunsigned("pattern", 64 - SLOT_BITS)
    pages = patterns.select(F.shiftright(slot, 15).alias("page"), slot.bitwiseAND(F.lit(0x7FFF)).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bitmap = bytearray(1 << SLOT_BITS - 3)
    for r in pages.collect():  # at most 2**(SLOT_BITS - 15) rows of 4 KB
        bitmap[r["page"] << 12 : r["page"] + 1 << 12] = r["bits"]
    sent = docs.sparkSession.sparkContext.broadcast(bytes(bitmap))
    counted = docs.select("text").mapInArrow(_count(sent), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    return counted.join(patterns, "pattern", "left_semi")


def score_patterns(occurrences: DataFrame, contexts: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, kind, confidence) of the accepted patterns.

    occurrences: pattern, slot (key of its words in contexts), kind, instance, seed (boolean); contexts: slot, total; patterns
    without a total are left out. Links are counted first, so a pattern or an instance that fills a large part of the corpus is
    summed map-side, not gathered.
    """
    links = occurrences.groupBy("pattern", "slot", "kind", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    links = C.materialise(links.join(contexts, "slot"), "links")
    reliable = links.select("pattern", "kind", "instance", "seed", "n", "total", F.col("seed").cast("double").alias("r"))
    for k in range(rounds):
        scored = reliable.groupBy("pattern", "kind").agg((F.sum(F.col("n") * F.col("r")) / F.max("total")).alias("c"), F.sum((F.col("r") >= 0.5).cast("long")).alias("fillers"))
        scored = scored.where((F.col("fillers") >= support) & (F.col("c") >= confidence)).select("pattern", "kind", F.least("c", F.lit(0.999)).alias("c"))
        if k + 1 < rounds:
            hit = links.where("not seed").join(scored, ["pattern", "kind"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("c"))))).alias("x"))
            reliable = links.join(hit, ["kind", "instance"], "left").select("pattern", "kind", "instance", "seed", "n", "total", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("x", F.lit(0.0))).alias("r"))
    return scored.withColumnRenamed("c", "confidence")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _found(docs: DataFrame, rounds: int, support: int, confidence: float) -> tuple[DataFrame, DataFrame]:
    """Base rows (id, key, spans, counts), and added spans (id, key, added: array of kind:start:end)."""
    ship_package(docs.sparkSession)
    texts = _keyed(docs)
    scan = C.materialise(texts.mapInArrow(_scan, _SCHEMA), "pii")
    occ = scan.where("t = 1").withColumn("seed", F.col("n") > 0)
    enough = occ.select("pattern", "kind", "instance").distinct().groupBy("pattern", "kind").count().where(F.col("count") >= support)
    patterns = C.materialise(enough.select("pattern").distinct(), "patterns")
    contexts = context_totals(texts, patterns).withColumnRenamed("pattern", "slot")
    accepted = score_patterns(occ.select("pattern", F.col("pattern").alias("slot"), "kind", "instance", "seed"), contexts, rounds, support, confidence)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    added = occ.where("not seed").join(accepted, ["pattern", "kind"]).select("id", "key", F.concat_ws(":", name, "start", "end").alias("span"))
    return scan.where("t = 0").select("id", "key", "spans", "counts"), added.groupBy("id", "key").agg(F.collect_set("span").alias("added"))


def _all_spans(base: str, added) -> list[tuple[int, int, int]]:
    out = []
    for x in [*(base.split(",") if base else []), *(added or [])]:
        kind, s, e = x.split(":")
        out.append((int(s), KINDS.index(kind), int(e)))
    return sorted(out)


def _report(batches):
    for b in batches:
        base, added = b.column("spans").to_pylist(), b.column("added").to_pylist()
        counts = np.array(b.column("counts").to_pylist(), np.int64).reshape(-1, 4)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in base]
        every = [x if not a else joined(_all_spans(x, a)) for x, a in zip(base, added, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(counts[:, k]) for k in range(4)), pa.array(sha), pa.array(every), pa.array([len(a or []) for a in added], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])


def _same(left: str = "", right: str = "") -> F.Column:
    return F.col(f"{left}id").eqNullSafe(F.col(f"{right}id")) & (F.col(f"{left}key") == F.col(f"{right}key"))


def find(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per document: doc_id, n_email .. n_phone (base spans), base_sha256, spans (all spans), n_added."""
    base, added = _found(docs, rounds, support, confidence)
    rows = base.alias("b").join(added.alias("a"), _same("b.", "a."), "left").select("b.id", "b.spans", "b.counts", "a.added")
    return rows.mapInArrow(_report, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one, named by the first."""
    out, at = [], 0
    i = 0
    while i < len(spans):
        s, k, e = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < e:
            e = max(e, spans[i][2])
            i += 1
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all found spans are masked; every document and column stays."""
    _, added = _found(docs, ROUNDS, SUPPORT, CONFIDENCE)
    names = docs.columns
    own, own_key, flag_id, flag_key, flag = C.fresh(names, "own_id", "own_key", "flag_id", "flag_key", "flags")
    marked = docs.select("*", F.col("doc_id").cast("long").alias(own), F.xxhash64("text").alias(own_key))
    added = added.select(F.col("id").alias(flag_id), F.col("key").alias(flag_key), F.col("added").alias(flag))
    same = F.col(own).eqNullSafe(F.col(flag_id)) & (F.col(own_key) == F.col(flag_key))
    joined_ = marked.join(added, same, "left").select(*(F.col(f"`{c}`") for c in names), flag)

    def run(batches):
        for b in C.chunks(batches, "text"):
            text, added_ = b.column("text").to_pylist(), b.column(flag).to_pylist()
            data, off = C.utf8(b.column("text"))
            total = np.concatenate([[0], np.cumsum(_MARK[data])])
            for i in np.flatnonzero((total[off[1:]] > total[off[:-1]]) | np.array([bool(a) for a in added_], bool)).tolist():
                spans = sorted([*base_spans(text[i]), *_all_spans("", added_[i])])
                if spans:
                    text[i] = mask(text[i], spans)
            columns = [pa.array(text, b.column("text").type) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    masked = joined_.mapInArrow(run, docs.schema)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else masked


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
