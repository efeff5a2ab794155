"""Packing along a space-filling curve.

Each document is tokenised whole and ended by one id. Its token counts are hashed to a few dimensions (fixed random signs per
token id), the direction is quantised, and its place on a Hilbert curve becomes its key. Documents are range-sorted by that
key; neighbours on the curve are laid end to end, and the stream is cut every `length` ids, so only the last sequence can
need padding. Start positions come from sums per range partition, whose number is all that reaches the driver.

Tokenising: text is split at ASCII white space, which no token crosses; the ids of each such word are found once and kept in
a bounded table per worker. A new word goes through the normaliser, the split pattern and the merges; words with characters
beyond Latin Extended-B, and whole texts that hold a string of one of the vocabulary's added tokens, go through the tokenizers
library itself: ids are those of `Tokenizer.from_file(vocabulary).encode(text, add_special_tokens=False)`.

Defined results: a null text is empty (its one id is the end id); a null id stays null and sorts first; repeated rows are
packed one by one; an empty table gives no rows; columns beyond id and text are not read.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import common as C

LENGTH, END_ID = 2048, 1
DIMENSIONS, BITS = 4, 8
#: Words whose ids a worker keeps at once.
CACHE_WORDS = 500_000
#: Fixed value: the split pattern of the vocabulary's pre-tokenizer.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def _byte_symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: themselves where printable, else from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer(dict):
    """Ids of words as little-endian 16-bit strings, found on demand; a space plays the part of the end-of-word mark."""

    def __init__(self, blob: bytes, limit: int = CACHE_WORDS):
        import regex
        import tiktoken

        super().__init__()
        self.limit = limit
        file = json.loads(blob)
        model = file["model"]
        if any(t["normalized"] for t in file["added_tokens"]):
            raise ValueError("an added token is looked up in the normalised text")
        self.added = tuple(t["content"].encode() for t in file["added_tokens"])
        mark, symbols = model["end_of_word_suffix"], _byte_symbols()
        ranks = {}
        for token, i in model["vocab"].items():
            whole = token.endswith(mark) and token != mark
            body = token[: -len(mark)] if whole else token
            if all(c in symbols for c in body) and not (token.startswith("<|") and token.endswith("|>")):
                ranks[bytes(symbols[c] for c in body) + b" " * whole] = i
        self.merges = tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.find = regex.compile(PIECES).findall
        self.blob, self.library = blob, None
        if max(model["vocab"].values()) > 0xFFFF:
            raise ValueError("the vocabulary does not fit 16-bit ids")

    @property
    def slow(self):
        """The tokenizers library's own encoder, built when a word first needs it."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.blob.decode())
        return self.library

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters: one piece
            ids = self.merges.encode_single_piece(word.lower() + b" ")
        else:
            ids = self._pieces(word.decode("utf-8", "replace"))
        if len(self) >= self.limit:
            self.clear()
        out = self[word] = struct.pack(f"<{len(ids)}H", *ids)
        return out

    def _pieces(self, text: str) -> list[int]:
        if text.isascii():
            low = text.lower()
        else:
            text = unicodedata.normalize("NFC", text)
            if max(text) >= "ɐ":
                return self.slow.encode(text, add_special_tokens=False).ids
            low = "".join([c.lower() for c in text])
        one = self.merges.encode_single_piece
        return [i for piece in self.find(low) for i in one(piece.encode() + b" ")]

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text, two bytes each."""
        if any(t in text for t in self.added):
            return np.array(self.slow.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u2").tobytes()
        return b"".join(map(self.__getitem__, text.split()))


def word_tokenizer(blob: bytes) -> WordTokenizer:
    """The tokenizer of a vocabulary file, built once in each worker."""
    return C.held("words", (zlib.crc32(blob), len(blob)), lambda: WordTokenizer(blob))


def signs(dimensions: int = DIMENSIONS) -> np.ndarray:
    """+1 or -1 for each 16-bit id and dimension, from a hash."""
    x = C.mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x51ED270B))
    return np.stack([((x >> np.uint64(7 * d + 3)) & np.uint64(1)).astype(np.int32) * 2 - 1 for d in range(dimensions)], axis=1)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve position of rows of cell coordinates below 2**bits."""
    x = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    n = len(x)
    for b in range(bits - 1, 0, -1):  # undo the turns of each level, from the coarsest
        low = (1 << b) - 1
        for d in range(n):
            on = (x[d] >> b) & 1
            swap = np.where(on == 1, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(on == 1, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
    for d in range(1, n):
        x[d] = x[d] ^ x[d - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t = np.where((x[n - 1] >> b) & 1, t ^ ((1 << b) - 1), t)
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            key = key << 1 | ((x[d] ^ t) >> b) & 1
    return key


def _tokenise(sent, end_id: int, dimensions: int, bits: int):
    def run(batches):
        C.trim("words")
        tok, table = word_tokenizer(sent.value), signs(dimensions)
        end = np.array([end_id], "<u2").tobytes()
        for part in C.chunks(batches, "text", kind="words"):
            data, off = C.utf8(part.column("text"))
            raw = data.tobytes()
            out = [tok.encode(raw[a:b]) + end for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            n = np.array([len(x) // 2 for x in out], np.int64)
            sums = np.add.reduceat(table[np.frombuffer(b"".join(out), "<u2")], np.cumsum(n) - n, axis=0).astype(float)
            unit = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-9)
            cells = np.minimum(((unit + 1) / 2 * (1 << bits)).astype(np.int64), (1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(hilbert(cells, bits)), pa.array(n), pa.array(out, pa.binary())], ["doc_id", "curve", "n", "ids"])

    return run


def _running(batches):
    """Start of each document within its partition, in the partition's order."""
    at = 0
    for b in batches:
        n = b.column("n").to_numpy()
        start = at + np.cumsum(n) - n
        at += int(n.sum())
        yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("part"), pa.array(start), b.column("n")], ["uid", "part", "local", "n"])


def _pieces(length: int, total: int):
    tail = total % length
    last = tail if tail and tail & (tail - 1) == 0 else length

    def run(batches):
        for part in C.chunks(batches, "ids"):
            data, off = C.utf8(part.column("ids"))
            raw = memoryview(data.tobytes())
            g, n = part.column("start").to_numpy(), part.column("n").to_numpy()
            count = (g + n - 1) // length - g // length + 1
            doc = np.repeat(np.arange(len(n)), count)
            seq = np.repeat(g // length, count) + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            low = np.maximum(seq * length, g[doc])
            high = np.minimum((seq + 1) * length, (g + n)[doc])
            start = low - g[doc]
            wide = np.frombuffer(raw, "<u2").astype("<u4").tobytes() if len(raw) else b""
            a = ((off[doc] >> 1) + start) * 4
            view = memoryview(wide)
            crc = [zlib.crc32(view[s:e]) for s, e in zip(a.tolist(), (a + (high - low) * 4).tolist(), strict=True)]
            padded = np.where(seq == total // length, last, length)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(doc)), *(pa.array(x) for x in (start, high - low, np.array(crc, np.int64), n[doc], seq, low % length, padded))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"],
            )

    return run


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, dimensions: int = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length (of its sequence)."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())  # a vocabulary file, a few MB
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = rows.mapInArrow(_tokenise(sent, end_id, dimensions, bits), "doc_id long, curve long, n long, ids binary")
    tokens = C.materialise(tokens.withColumn("uid", F.monotonically_increasing_id()), "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["curve", "doc_id", "uid"]
    ranged = tokens.select(*order, "n").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = C.materialise(ranged.select("uid", F.spark_partition_id().alias("part"), "n").mapInArrow(_running, "uid long, part int, local long, n long"), "placed")
    totals = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row per partition
    base, at = [], 0
    for part, n in totals:
        base.append((part, at))
        at += n
    bases = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    starts = placed.join(bases, "part").select("uid", (F.col("base") + F.col("local")).alias("start"))
    joined = tokens.join(starts, "uid").select("doc_id", "n", "start", "ids")
    return joined.mapInArrow(_pieces(length, at), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of every document."""
    return pack(docs, default_vocabulary())


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_vocabulary())
