"""Global order without a single task: running sums and dense ranks over range partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagelake.llm.common import written


def running_sums(df: DataFrame, order: list[Column], value: str, group: str | None = None, what: str = "sums") -> DataFrame:
    """df with `before`: the sum of `value` (long) over the rows of the same group that come earlier in `order`.

    The rows are dealt out by ranges of (group, order), so that a group of any size is spread over
    many tasks. Each task adds up what it holds, in one pass over its sorted rows; the sums of the
    earlier tasks, one row for each task and group, are then added. Rows that tie in `order` come
    in any order, so `order` should end in a key. Null groups form a group.
    """
    spark = df.sparkSession
    by = ([F.col(group).asc_nulls_last()] if group else []) + order
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by)
    kind = df.schema[group].dataType if group else None
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in df.schema], T.StructField("pid", T.IntegerType()), T.StructField("local", T.LongType())])
    at_group = df.columns.index(group) if group else -1
    at_value = df.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        pid, last, carry, first = TaskContext.get().partitionId(), None, 0, True
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = b.column(at_value).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(v) - v
            if at_group < 0:
                local, carry = sums + carry, carry + int(v.sum())
            else:
                g = b.column(at_group)
                starts = np.ones(n, bool)
                if n > 1:
                    same = pc.fill_null(pc.equal(g.slice(1), g.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
                    null = pc.is_null(g).to_numpy(zero_copy_only=False)
                    starts[1:] = ~(same | (null[1:] & null[:-1]))
                begin = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
                local = sums - sums[begin]
                run_on = not first and g[0].as_py() == last
                if run_on:
                    local[begin == 0] += carry
                carry, last, first = int(local[-1] + v[-1]), g[n - 1].as_py(), False
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, pid, np.int32)), pa.array(local)], names=[*b.schema.names, "pid", "local"])

    sums = written(ordered.mapInArrow(run, schema), what)
    keys = ["pid", *([group] if group else [])]
    parts = sums.groupBy(*keys).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).cast("long").alias("part"))
    across = W.partitionBy(group) if group else W.partitionBy(F.lit(1))
    parts = parts.withColumn("earlier", F.coalesce(F.sum("part").over(across.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("part")
    if group:
        parts = parts.withColumnRenamed(group, "part_group").withColumnRenamed("pid", "part_pid")
        out = sums.join(parts, (sums["pid"] == parts["part_pid"]) & sums[group].eqNullSafe(parts["part_group"]), "left")
    else:
        parts = parts.withColumnRenamed("pid", "part_pid")
        out = sums.join(parts, sums["pid"] == parts["part_pid"], "left")
    assert kind is None or kind == df.schema[group].dataType
    out = out.select(*[sums[c] for c in df.columns], (F.col("local") + F.coalesce("earlier", F.lit(0))).alias("before"))
    out._llm_path = getattr(sums, "_llm_path", None)
    return out


def dense_rank(df: DataFrame, keys: list[str], what: str = "rank", distinct: bool = False) -> DataFrame:
    """Distinct keys of df with `rank`: 0-based place in ascending order (nulls last), found without a single task.

    distinct: the keys are known to be distinct.
    """
    found = df.select(*keys)
    distinct = (found if distinct else found.distinct()).withColumn("one", F.lit(1).cast("long"))
    return running_sums(distinct, [F.col(k).asc_nulls_last() for k in keys], "one", None, what).drop("one").withColumnRenamed("before", "rank")
