"""Order-dependent operators that stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagelake.session import checkpointed


def running_total(df: DataFrame, order: list[Column], value: str, name: str = "before") -> DataFrame:
    """df with the sum of value over all rows that come earlier in a global order.

    Rows are dealt out by range, each range is summed on its own, and the sums of the earlier ranges
    (one row for each range) are added: no window over the whole table in one task.
    """
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    within = F.coalesce(F.sum(value).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col("_range").alias("_of"), earlier.alias("_offset"))
    return ranged.withColumn("_within", within).join(F.broadcast(offsets), F.col("_range") == F.col("_of")).withColumn(name, F.col("_within") + F.col("_offset")).drop("_range", "_of", "_within", "_offset")


def every(df: DataFrame, first: str, size: str, step: int, name: str = "place") -> DataFrame:
    """A row for each place divisible by step among the size places that a row takes from first on.

    Each row makes its own places, so that looking up many places is no join at all.
    """
    least = (F.ceil(F.col(first) / step) * step).cast("long")
    most = (F.col(first) + F.col(size) - 1).cast("long")
    return df.withColumn(name, F.explode(F.when(least <= most, F.sequence(least, most, F.lit(step).cast("long")))))


def last_record_wins(log: DataFrame, key: str, order: str, op: str, put: str = "put") -> DataFrame:
    """The live record of each key: its last one, if that is a put. An aggregate, not a sort of each key's history."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), order).alias("last"))
    return last.select(key, "last.*").filter(F.col(op) == put)


def complete_prefix(log: DataFrame, order: str, good: Column) -> DataFrame:
    """Records before the first bad one."""
    first = log.agg(F.min(F.when(~good, F.col(order))).alias("_first"))
    return log.crossJoin(F.broadcast(first)).filter(F.col("_first").isNull() | (F.col(order) < F.col("_first"))).drop("_first")


def greedy_batches(sizes: list[int], target: int) -> list[list[int]]:
    """Places of consecutive items in batches of at most target, at least one each."""
    out: list[list[int]] = []
    held = 0
    for i, n in enumerate(sizes):
        if out and held + n <= target:
            out[-1].append(i)
            held += n
        else:
            out.append([i])
            held = n
    return out
