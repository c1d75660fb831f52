"""Connected components by alternating large-star and small-star steps over written tables.

First each task contracts the edges it reads to a forest (union-find over what one partition
holds); then the two steps alternate until nothing changes. A step is a minimum per node, partially
aggregated before the shuffle, joined back to the edges; a node with very many edges is split by
the adaptive skew join. Each round is written to the shared folder, and the round before deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake.llm.common import forget, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of a batch of edges that aren't least themselves."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    u, v = index[: len(a)], index[len(a) :]
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        label = label[label]
        if np.array_equal(label, before):
            break
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def contracted(edges: DataFrame) -> DataFrame:
    """(a, b) with the same components, at most one edge for each node of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            pair = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held.append(pair)
            n += len(pair[0])
            if n > 2_000_000:
                held = [forest(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                n = len(held[0][0])
        if n:
            a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for i in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], names=["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written, so that the join gets shuffles of its own, in which a node with very many edges can be split.
    least = written(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = both.filter("b > a").join(least, both["a"] == least["u"])
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = written(down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least")
    moved = down.join(least, down["a"] == least["u"]).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").bitwiseAND(0xFFFFFFFF))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): every node of edges (a, b: long, not null), and the least node it reaches."""
    now = written(contracted(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")), "stars")
    seen = state(now)
    while seen[0]:
        then, now = now, written(small_star(large_star(now)), "stars")
        forget(then)
        new = state(now)
        if new == seen:
            break
        seen = new
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
