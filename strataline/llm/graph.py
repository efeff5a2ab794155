"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Links that one local contraction holds at once.
LOCAL_LINKS = 500_000


def _contract(batches):
    """Spanning stars of the links of blocks of a partition: the same components from fewer, flatter links."""

    def stars(a, b):
        nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = np.arange(len(nodes))
        u, v = inverse[: len(a)], inverse[len(a) :]
        while True:
            low = np.minimum(label[u], label[v])
            new = label.copy()
            np.minimum.at(new, label[u], low)
            np.minimum.at(new, label[v], low)
            np.minimum.at(new, u, low)
            np.minimum.at(new, v, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        own = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        n += batch.num_rows
        if n >= LOCAL_LINKS:
            yield stars(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield stars(*map(np.concatenate, zip(*held, strict=True)))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of (u long, v long) that is not its component's smallest node."""
    spark = links.sparkSession
    path = C.scratch(spark, "links")
    edges = C.materialise(links.select("u", "v").where("u <> v").mapInArrow(_contract, "u long, v long").distinct(), "links", path)
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # now every u has its links to smaller nodes only
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new_path = C.scratch(spark, "links")
        edges = C.materialise(small, "links", new_path)
        C.remove(spark, path)
        path = new_path
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == now:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
