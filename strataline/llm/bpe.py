"""Byte-level BPE encoding and decoding as a monoid tree reduction.

An element of the monoid is a text with its ids. Encoding cuts a text into halves until they fit a leaf, encodes leaves, and
joins neighbours: a window around the cut grows on both sides until each side holds a place where a letter or digit is
followed by a space or line feed (or until the side is used up). No alternative of the split pattern has white space after
other characters, so every such place is a piece boundary whatever stands around it: ids outside the window are final, and
only the window is encoded again. Decoding concatenates token bytes up the same kind of tree.

Defined results: a null text is empty (no ids, hashes of nothing); a null id stays null; repeated rows give repeated
results; an empty table gives no rows; columns beyond id and text are not read; a text is never cut short.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import common as C

#: Characters of a leaf and of a first window on each side.
LEAF, WINDOW = 512, 32


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: bytes, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.leaf, self.window, self.joins = max(2, leaf), max(1, window), 0
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.bytes_of = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            self.bytes_of[rank] = token

    def plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=())

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return self.plain(text)
        cut = len(text) // 2
        left, right = text[:cut], text[cut:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
        """Ids of left + right from the ids of both."""
        self.joins += 1
        if not left or not right:
            return left_ids if left else right_ids
        a, b = self._last_boundary(left), self._first_boundary(right)
        keep = self._tokens(left_ids, len(left[a:].encode()), -1)
        drop = self._tokens(right_ids, len(right[:b].encode()), 1)
        return np.concatenate([left_ids[: len(left_ids) - keep], self.plain(left[a:] + right[:b]), right_ids[drop:]])

    def _last_boundary(self, text: str) -> int:
        size = self.window
        while True:
            low = max(1, len(text) - size)
            for p in range(len(text) - 1, low - 1, -1):
                if text[p] in " \n" and text[p - 1].isalnum():
                    return p
            if low == 1:
                return 0
            size *= 2

    def _first_boundary(self, text: str) -> int:
        size = self.window
        done = 1
        while True:
            high = min(len(text), size)
            for p in range(done, high):
                if text[p] in " \n" and text[p - 1].isalnum():
                    return p
            if high == len(text):
                return len(text)
            done, size = high, 2 * size

    def _tokens(self, ids: np.ndarray, n_bytes: int, step: int) -> int:
        """How many tokens at the end (step -1) or start (1) make n_bytes."""
        n, at = 0, -1 if step < 0 else 0
        while n_bytes > 0:
            n_bytes -= len(self.bytes_of[ids[at]])
            n, at = n + 1, at + step
        if n_bytes:
            raise AssertionError("a piece boundary splits a token")
        return n

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            table = self.bytes_of
            return b"".join([table[i] for i in ids.tolist()])
        cut = len(ids) // 2
        return self.decode(ids[:cut]) + self.decode(ids[cut:])


def codec(ranks: bytes, pattern: str) -> Codec:
    """The codec of a rank file, built once in each worker."""
    return C.held("bpe", hashlib.sha256(ranks + pattern.encode()).digest(), lambda: Codec(ranks, pattern))


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids array<int> if asked) of each text; `vocabulary`: path of a rank file."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())  # a vocabulary file, about 1 MB

    def run(batches):
        C.trim("bpe")
        c = codec(sent.value, pattern)
        for part in C.chunks(batches, "text", kind="bpe"):
            n, ih, dh, every = [], [], [], []
            for text in part.column("text").to_pylist():
                ids = c.encode(text or "")
                n.append(len(ids))
                ih.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                dh.append(hashlib.sha256(c.decode(ids)).hexdigest())
                every.append(ids)
            columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ih, pa.string()), pa.array(dh, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array([x.astype(np.int32) for x in every], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
