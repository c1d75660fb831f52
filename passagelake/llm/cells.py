"""All pairs inside buckets, in bounded pieces.

A bucket of more than `size` rows is split into blocks by a hash of the row; each pair of blocks is
a cell of its own, so that no task ever holds more than two blocks, and every pair of rows of the
bucket meets in exactly one cell. Rows of one cell are brought together by a sort, not collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deal(rows: DataFrame, bucket: list[str], identity: Column, size: int, weight: Column | None = None, heaviest: int = 1) -> DataFrame:
    """rows, repeated for each cell they belong to, with low, high (the cell's blocks) and block; sorted by cell.

    A block has about `size` rows, and with weight a total of about `heaviest`.
    """
    parts = F.ceil(F.count("*") / size)
    if weight is not None:
        parts = F.greatest(parts, F.ceil(F.sum(weight) / heaviest))
    big = rows.groupBy(*[F.col(c).alias(f"big_{c}") for c in bucket]).agg(parts.cast("int").alias("n_parts")).filter(F.col("n_parts") > 1)
    on = None
    for c in bucket:
        same = F.col(c) == F.col(f"big_{c}")
        on = same if on is None else on & same
    x = rows.join(big, on, "left").withColumn("n_blocks", F.coalesce("n_parts", F.lit(1))).withColumn("block", F.pmod(F.xxhash64(identity), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    x = x.withColumn("other", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    x = x.select(*bucket, "low", "high", "block", *[c for c in rows.columns if c not in bucket])
    return x.repartition(*bucket, "low", "high").sortWithinPartitions(*bucket, "low", "high")


def cells(batches: Iterator[pa.RecordBatch], n_key: int) -> Iterator[pa.RecordBatch]:
    """Each run of at least two rows with equal first n_key columns (long or int), whole."""
    left: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if left is not None:
            batch = pa.concat_batches([left, batch])
        change = np.zeros(batch.num_rows - 1, bool)
        for i in range(n_key):
            k = batch.column(i).to_numpy()
            change |= k[1:] != k[:-1]
        starts = np.r_[0, np.flatnonzero(change) + 1]
        ends = np.r_[starts[1:], batch.num_rows]
        for s, e in zip(starts[:-1][ends[:-1] - starts[:-1] > 1].tolist(), ends[:-1][ends[:-1] - starts[:-1] > 1].tolist(), strict=True):
            yield batch.slice(s, e - s)
        left = batch.slice(int(starts[-1]))
    if left is not None and left.num_rows > 1:
        yield left


def spanning(n: int, neighbours: Callable[[int], np.ndarray], label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of n rows, where neighbours(i) gives linked rows after i.

    Rows of equal label are joined from the start; label follows in place.
    """
    if label is None:
        label = np.arange(n)
    out = []
    for i in range(n):
        js = neighbours(i)
        if not len(js):
            continue
        found, first = np.unique(label[js], return_index=True)
        own = label[i]
        for x, j in zip(found.tolist(), js[first].tolist(), strict=True):
            if x != own:
                out.append((i, j))
                label[label == x] = own
    return out
