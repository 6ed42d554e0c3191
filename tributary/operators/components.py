"""Connected components of a graph given as a table of edges, by rounds of joins; nothing of the graph comes to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import written


#: Up to so many edges, 16 bytes each, are joined by union-find in one task; more by rounds of joins.
SMALL_EDGES = 2_000_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.stack([b.column("u").to_numpy(), b.column("v").to_numpy()]) for b in batches]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    u, v = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:  # nodes are sorted, so the least number is the least node
        low = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, label[u], low)
        np.minimum.at(after, label[v], low)
        after = after[after]
        after = after[after]
        if (after == label).all():
            break
        label = after
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node reachable) of every node of the edges (columns a and b, longs).

    Beyond `SMALL_EDGES` by large-star and small-star rounds (Kiveris et al., 2014): every node's larger neighbours, then
    its smaller ones, are tied to the least node around it. Each round is written to the shared folder; the number of
    rounds grows with the logarithm of the longest path.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "components")
    state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"))
    before = state.first()
    if before["n"] <= SMALL_EDGES:
        return e.coalesce(1).mapInArrow(_union_find, "node long, component long")
    while True:
        # large star: for every node, its larger neighbours go to the least of its neighbourhood
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: its smaller neighbours and itself go to the least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        e = written(small, "components")
        after = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if after == before:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(e.select("v", "v").distinct())
        before = after
