"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Training takes a bounded sample (`sample` vectors, those with the smallest hash of their id): k-means gives the coarse
centroids, about 8 * sqrt(rows) of them as far as the sample can fit them (LEAST vectors each), and k-means in each subspace
of the residuals gives the code books. How many lists a query visits is read off a measured curve: for some vectors of the
sample, in how many of the nearest lists their true neighbours in the sample lie; `target` of these must be reached. So
clustered vectors cost few lists, and vectors without any structure cost many, at the same recall.

Every valid vector is indexed: it goes to its nearest centroid's list as one byte per subspace and one number that no query
changes. Lists that lie close together form a group; a group of more than GROUP vectors is cut by a hash of the id, so a hot
list is many groups. Vectors are sent to their group once. A query is sent once to each group that holds a list it visits,
and scores the group's codes through its own asymmetric distance tables: squared distance = |q - c|^2 - 2 q.r + (|r|^2 + 2 c.r)
for a residual r of list c, where q.r is a sum over table entries. A group yields at most `rerank` candidates of a query; the
best `rerank` of all, ties to smaller ids, are ranked anew by the exact distance of the original vectors. Vectors with equal
codes and distances keep the order of their ids throughout, so a group of copies yields its smallest ids.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, neither do vectors of a
length other than `dimension` (by default the commonest one; ties: the longer), nor rows without id; repeated rows (same id)
count once, with the smallest vector; fewer candidates than k give fewer rows; no valid query gives no rows; other columns
are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from . import common as C

SAMPLE = 20_000
#: Sampled vectors that a list needs; sampled vectors whose neighbours are looked up for the curve of visited lists.
LEAST, MEASURED = 8, 256
#: Share of the true neighbours that the visited lists must hold, as measured on the sample.
TARGET = 0.95
#: Vectors of a group; scores that a group's task holds at once.
GROUP, SCORES = 1 << 18, 1 << 22


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids of the rows of x; empty ones are put on the rows farthest from theirs."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].astype(np.float64).copy()
    for _ in range(rounds):
        near, dist = nearest(x, c)
        count = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            c[empty] = x[np.argsort(-dist, kind="stable")[: len(empty)]]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row."""
    half = (c * c).sum(1) / 2
    near, dist = np.empty(len(x), np.int64), np.empty(len(x))
    for i in range(0, len(x), 4096):
        d = half - x[i : i + 4096] @ c.T
        near[i : i + 4096] = d.argmin(1)
        dist[i : i + 4096] = 2 * d.min(1) + (x[i : i + 4096] ** 2).sum(1)
    return near, dist


class Quantiser:
    """Coarse centroids, residual code books and the number of lists to visit; of a size that the parameters fix."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, codes: int = 256, target: float = TARGET, k: int = 10):
        self.coarse = kmeans(sample, max(1, min(lists, len(sample) // LEAST)))
        cell, _ = nearest(sample, self.coarse)
        residual = sample - self.coarse[cell]
        bounds = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
        self.slices = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        some = residual[: 32 * codes]
        self.books = [kmeans(some[:, s], min(codes, len(some))) for s in self.slices]
        self.probe = self._curve(sample, cell, target, k)

    def _curve(self, sample: np.ndarray, cell: np.ndarray, target: float, k: int) -> int:
        """The least number of nearest lists that hold `target` of the true neighbours of sampled vectors."""
        q = sample[:MEASURED]
        d = (sample * sample).sum(1) - 2 * q @ sample.T
        d[np.arange(len(q)), np.arange(len(q))] = np.inf
        true = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        if not true.size:
            return len(self.coarse)
        order = np.argsort(self.distances(q), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(self.coarse))[None], 1)
        need = np.sort(np.take_along_axis(place, cell[true], 1).ravel())
        return int(need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)]) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code, and the part of the distance that no query changes, of each vector."""
        cell, _ = nearest(x, self.coarse)
        c = self.coarse[cell]
        r = x - c
        codes = np.stack([nearest(r[:, s], b)[0] for s, b in zip(self.slices, self.books, strict=True)], axis=1).astype(np.uint8)
        near = np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)
        return cell, codes, (near * near).sum(1) + 2 * (c * near).sum(1)

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the centroids."""
        return (q * q).sum(1)[:, None] - 2 * q @ self.coarse.T + (self.coarse**2).sum(1)

    def visits(self, q: np.ndarray, probe: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances to all lists, and which lists a query visits."""
        d = self.distances(q)
        on = np.zeros(d.shape, bool)
        np.put_along_axis(on, np.argsort(d, axis=1, kind="stable")[:, :probe], True, 1)
        return d, on

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Asymmetric tables: for each subspace, the products of queries (rows) and code words (columns)."""
        return [q[:, s] @ b.T for s, b in zip(self.slices, self.books, strict=True)]


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id long, v array<double>) of the rows that take part."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _encode(sent):
    """List, code and constant part of each vector."""

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 4096) for i in range(0, b.num_rows, 4096)):
                cell, codes, term = sent.value.encode(_matrix(part.column("v")))
                raw = codes.tobytes()
                n = codes.shape[1]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cell.astype(np.int32)), pa.array([raw[i : i + n] for i in range(0, len(raw), n)], pa.binary()), pa.array(term)], ["id", "cell", "data", "term"])

    return run


def _assign(sent, probe: int):
    """A query for each group that holds a list it visits."""

    def run(batches):
        q, start, cuts = sent.value  # per list: its group, and into how many the group is cut
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids, v = part.column("id").to_numpy(), _matrix(part.column("v"))
                _, on = q.visits(v, probe)
                for j, x in enumerate(v):
                    first, at = np.unique(start[on[j]], return_index=True)
                    n = cuts[on[j]][at]
                    group = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(np.ones(len(group), np.int32)), pa.array(np.full(len(group), -1, np.int32)), pa.array(np.full(len(group), ids[j], np.int64)), pa.array([x.astype("<f8").tobytes()] * len(group), pa.binary()), pa.array(np.zeros(len(group)))], _ROW)

    return run


_ROW = ["group", "kind", "cell", "id", "data", "term"]


def _candidates(q: Quantiser, probe: int, rerank: int, cell, ids, codes, term, qids, v):
    """(query, id, approximate squared distance): the best of a group for each query that visits one of its lists."""
    d, on = q.visits(v, probe)
    tables = q.tables(v)
    score = np.repeat(term[None], len(v), axis=0)
    for j, t in enumerate(tables):
        score -= 2 * t[:, codes[:, j]]
    score += d[:, cell]
    score[~on[:, cell] | (ids[None] == qids[:, None])] = np.inf
    for i, s in enumerate(score):
        at = np.flatnonzero(s <= np.partition(s, rerank)[rerank]) if len(s) > rerank else np.arange(len(s))  # all that can rank, ties included
        at = at[np.isfinite(s[at])]
        at = at[np.lexsort((ids[at], s[at]))[:rerank]]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), qids[i], np.int64)), pa.array(ids[at]), pa.array(s[at])], ["query_id", "id", "approx"])


def _scan(sent, probe: int, rerank: int):
    """Candidates from rows in order of group and kind: a group's vectors come before its queries."""

    def run(batches):
        q, group, held, index = sent.value[0], None, [], None
        for b in batches:
            g, kind = b.column("group").to_numpy(), b.column("kind").to_numpy()
            cut = np.flatnonzero((g[1:] != g[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(g)], strict=True):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if g[lo] != group:
                    group, held, index = g[lo], [], None
                ids, data = part.column("id").to_numpy(), b"".join(part.column("data").to_pylist())
                if kind[lo] == 0:
                    held.append((part.column("cell").to_numpy(), ids, np.frombuffer(data, np.uint8).reshape(len(ids), -1), part.column("term").to_numpy()))
                elif held:
                    index = index or [np.concatenate(x) for x in zip(*held, strict=True)]
                    v = np.frombuffer(data, "<f8").reshape(len(ids), -1)
                    step = max(1, SCORES // len(index[1]))
                    for i in range(0, len(ids), step):
                        yield from _candidates(q, probe, rerank, *index, ids[i : i + step], v[i : i + step])

    return run


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None, probe: int | None = None,
    parts: int = 16, rerank: int = 200, sample: int = SAMPLE, target: float = TARGET, dimension: int | None = None,
) -> DataFrame:
    """The k nearest found of each query: query_id, rank, vec_id, score (Euclidean, double precision).

    lists and probe follow from the number of rows and the measured curve unless given.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    every, asked = valid(vectors, id_col, vec_col), valid(queries, id_col, vec_col)
    sizes = every.where(F.size("v") == dimension) if dimension else every
    sizes = sizes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    every, asked = C.materialise(every.where(F.size("v") == sizes["d"]), "vectors"), asked.where(F.size("v") == sizes["d"])
    rows = every.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()  # at most `sample` rows
    q = Quantiser(np.array([r["v"] for r in rows], np.float64), lists or 8 * math.isqrt(sizes["count"]) + 1, parts, target=target, k=k)
    probe = probe or q.probe
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast(q)
    coded = C.materialise(every.mapInArrow(_encode(sent), "id long, cell int, data binary, term double"), "codes")
    # groups: neighbouring lists, each as large as a task can hold
    near, _ = nearest(q.coarse, kmeans(q.coarse, min(len(q.coarse), max(tasks, -(-sizes["count"] // GROUP)))))
    size = np.zeros(len(q.coarse), np.int64)
    for r in coded.groupBy("cell").count().collect():  # a row per list
        size[r["cell"]] = r["count"]
    cuts = np.maximum(1, -(-np.bincount(near, size).astype(np.int64) // GROUP))
    start = np.cumsum(cuts) - cuts
    grouped = spark.sparkContext.broadcast((q, start[near], cuts[near]))
    places = F.broadcast(spark.createDataFrame([(i, int(start[g]), int(cuts[g])) for i, g in enumerate(near.tolist())], "cell int, start int, cuts int"))  # a row per list
    group = (F.col("start") + F.pmod(F.xxhash64("id"), F.col("cuts"))).cast("int")
    indexed = coded.join(places, "cell").select(group.alias("group"), F.lit(0).alias("kind"), "cell", "id", "data", "term")
    wanted = asked.mapInArrow(_assign(grouped, probe), "group int, kind int, cell int, id long, data binary, term double")
    met = indexed.unionByName(wanted).repartition(max(tasks, int(cuts.sum())), "group").sortWithinPartitions("group", "kind")
    found = met.mapInArrow(_scan(grouped, probe, rerank), "query_id long, id long, approx double")
    order = Window.partitionBy("query_id").orderBy("approx", "id")
    short = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rerank).select("query_id", "id")
    exact = short.join(every, "id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id")
    score = F.sqrt(F.aggregate(F.zip_with("v", "qv", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y))
    ranked = exact.select("query_id", F.col("id").alias("vec_id"), score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_ann(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 100 = 0"))
