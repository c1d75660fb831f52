"""Near-duplicate vectors by random-hyperplane signs in several tables, verified by exact cosine.

Vectors are compared only within a label. Exact copies share one row from the start. Each table
hashes a vector to the signs of its products with some random hyperplanes; vectors with the same
signs meet in a bucket, where all pairs are verified in double precision. A pair that meets in
several tables counts in the first alone. Buckets over CELL rows are compared in blocks, and of
each cell come out the number of links of each vector and a spanning forest of the links, not the
pairs. Components are found by stars.

The number of signs grows with the largest label, so that a bucket holds about BUCKET random
vectors however many there are; the number of tables follows from it so that a pair at the
threshold meets in one of them with probability RECALL or more (closer pairs more often).

Results: vectors that are null, empty, zero, or hold a null or non-finite component, and rows
without label or vec_id, link with nothing: n_links 0, component their own id. Vectors of different
lengths do not link. Rows that repeat a vector count as vectors of their own. Labels may have any
type. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake.llm.cells import cells, deal, spanning
from passagelake.llm.common import forget, written
from passagelake.llm.components import connected

THRESHOLD = 0.93
RECALL = 0.99
BUCKET = 128
CELL = 2048
SEED = 5


def plan_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(signs, tables) for a label of n vectors."""
    same = 1 - math.acos(threshold) / math.pi
    bits = min(30, max(4, math.ceil(math.log2(max(n, 1) / BUCKET))) if n > BUCKET else 4)
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same**bits)))


def hyperplanes(dimensions: int, bits: int, tables: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, dimensions, bits, tables])).standard_normal((dimensions, bits * tables))


def usable(c: str):
    x = F.col(c)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def unit(column: pa.Array) -> np.ndarray:
    """Vectors of one length as unit vectors in double precision."""
    flat = column.flatten().cast(pa.float64()).to_numpy()
    v = flat.reshape(len(column), -1)
    v = v / np.abs(v).max(1, keepdims=True)  # first to a size whose square is a number
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def addressed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """Each class in each of its buckets: (group, dimensions, table, code, node, copies, codes, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            lengths = whole.column(1).to_numpy()
            for d in np.unique(lengths).tolist():
                batch = whole.filter(pa.array(lengths == d))
                if d not in planes:
                    planes[d] = hyperplanes(d, bits, tables)
                signs = (unit(batch.column(4)) @ planes[d] > 0).reshape(batch.num_rows, tables, bits)
                codes = (signs @ (1 << np.arange(bits))).astype(np.int32)
                n = batch.num_rows
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * tables + 1, tables, dtype=np.int32)), pa.array(codes.ravel()))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(n, t, np.int32)), pa.array(codes[:, t].copy()), batch.column(2), batch.column(3), lists, batch.column(4)], names=["group", "dimensions", "table", "code", "node", "copies", "codes", "embedding"])

    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.select("group", "dimensions", "node", "copies", "embedding").mapInArrow(run, f"group long, dimensions int, table int, code int, node long, copies long, codes array<int>, embedding {kind}")


def compare(dealt: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links): of each cell the forest (links null) and each vector's linked copies (b null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for cell in cells(batches, 6):
            low, high, block = cell.column(4)[0].as_py(), cell.column(5)[0].as_py(), cell.column(6).to_numpy()
            if low != high and (block == block[0]).all():
                continue
            table = cell.column(2)[0].as_py()
            node, copies = cell.column(7).to_numpy(), cell.column(8).to_numpy()
            v = unit(cell.column(10))
            near = v @ v.T >= threshold
            near = np.triu(near, 1)
            if low != high:
                near &= block[:, None] != block[None, :]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            codes = cell.column(9).flatten().to_numpy().reshape(len(node), -1)[:, :table]
            fresh = np.ones(len(i), bool)
            for s in range(0, len(i), 100_000):
                fresh[s : s + 100_000] = ~(codes[i[s : s + 100_000]] == codes[j[s : s + 100_000]]).any(1)
            i, j = i[fresh], j[fresh]
            if not len(i):
                continue
            n = np.bincount(i, copies[j], minlength=len(node)) + np.bincount(j, copies[i], minlength=len(node))
            starts = np.searchsorted(i, np.arange(len(node) + 1))
            held += [(int(node[a]), int(node[b]), None) for a, b in spanning(len(node), lambda k, j=j, starts=starts: j[starts[k] : starts[k + 1]])]
            held += [(int(node[k]), None, int(n[k])) for k in np.flatnonzero(n)]
            if len(held) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held, strict=True)], names=["a", "b", "links"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held, strict=True)], names=["a", "b", "links"])

    return dealt.mapInArrow(run, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label)."""
    good = usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # Two 64-bit hashes name a vector with its label; they stand for it in all that follows.
    keys = {"k0": F.when(good, F.xxhash64("label", "embedding")), "k1": F.when(good, F.xxhash64("embedding", "label", F.lit(SEED)))}
    rows = vectors.select("vec_id", "label", "embedding").withColumns(keys)
    classes = rows.filter("k0 is not null").groupBy("k0", "k1").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"), F.any_value("label").alias("label"))
    classes = written(classes.select("k0", "k1", F.col("node").cast("long").alias("node"), "copies", "embedding", F.xxhash64("label").alias("group"), F.size("embedding").cast("int").alias("dimensions")), "classes")
    largest = classes.groupBy("group", "dimensions").count().agg(F.max("count")).first()[0] or 0
    dealt = deal(addressed(classes, *plan_tables(largest, threshold, recall)), ["group", "dimensions", "table", "code"], F.col("node"), cell)
    found = written(compare(dealt, threshold), "links")
    parts = connected(found.filter("b is not null").select("a", "b"))
    counts = found.filter("b is null").groupBy(F.col("a").alias("linked")).agg(F.sum("links").alias("links"))
    of = classes.select("k0", "k1", "node", "copies")
    of = of.join(parts.withColumnRenamed("node", "part_node"), F.col("node") == F.col("part_node"), "left").join(counts, F.col("node") == F.col("linked"), "left")
    of = written(of.select(F.col("k0").alias("c0"), F.col("k1").alias("c1"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component_id")), "vectors")
    forget(found)
    narrow = rows.select("vec_id", "k0", "k1")
    out = narrow.join(of, (narrow["k0"] == of["c0"]) & (narrow["k1"] == of["c1"]), "left")
    component = F.coalesce(F.col("component_id"), F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
