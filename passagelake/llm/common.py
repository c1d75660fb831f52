"""Shared helpers: Arrow maps, written intermediate tables, vectorised text scans.

Every operator takes DataFrames and returns DataFrames. Intermediate results that are used more
than once are written as Parquet below the folder in ``spark.checkpoint.dir`` (shared by all
executors), so a lost executor costs only the re-run of its tasks.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagelake.session import shared_dir, ship

try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # not glibc
    _TRIM = None

#: Rows and bytes of one Arrow batch: texts are long, so batches stay small.
ARROW_ROWS = 1000
ARROW_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that all operators rely on: bounded Arrow batches, and workers that find this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/llm/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(df: DataFrame) -> None:
    """Delete the folder of a table made by written() that nothing reads any more."""
    path = getattr(df, "_llm_path", None)
    if path:
        delete(df.sparkSession, path)


class BitMap:
    """Upper bits of 64-bit hashes, in 4 MB at any number of them: a hash whose bit is 0 is not among them.

    It only spares joins the rows that can't match; rows whose bit is 1 need the join.
    """

    BITS = 25

    def __init__(self, bits: Broadcast):
        self.bits = bits

    @classmethod
    def of(cls, ids: DataFrame, name: str) -> BitMap:
        """Gathered as at most 2^19 rows of 64 bits."""
        bit = F.shiftrightunsigned(name, 64 - cls.BITS)
        one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{name}`, {64 - cls.BITS}) & 63 as int))")
        rows = ids.groupBy(F.shiftright(bit, 6).cast("int").alias("cell")).agg(F.bit_or(one).alias("bits")).toArrow()
        out = np.zeros(1 << (cls.BITS - 6), "<i8")
        out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
        return cls(ids.sparkSession.sparkContext.broadcast(out.tobytes()))

    def __contains__(self, h: int) -> bool:
        at = (h & 0xFFFFFFFFFFFFFFFF) >> (64 - self.BITS)
        return bool(self.bits.value[at >> 3] >> (at & 7) & 1)

    def holds(self, ids: Column) -> Column:
        bits, shift = self.bits, np.uint64(64 - self.BITS)

        def run(x: pa.Array) -> pa.Array:
            at = x.to_numpy(zero_copy_only=False).view(np.uint64) >> shift
            return pa.array((np.frombuffer(bits.value, np.uint8)[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool))

        return F.arrow_udf(run, "boolean")(ids)


def release() -> None:
    """Free memory goes back to the system, as the worker stays for other tasks: Arrow's, and what glibc keeps of numpy's."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def arrow_map(df: DataFrame, keep: list[str], inputs: list[str], fn: Callable[[dict[str, pa.Array]], dict[str, pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """Columns `keep` unchanged, plus `fields` that fn computes from `inputs`, batch by batch.

    Only the named columns are read, so other columns of df may have any names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [f"k{i}" for i in range(len(keep))]
    ins = [f"i{i}" for i in range(len(inputs))]
    picked = df.select(*[df[c].alias(a) for c, a in zip(keep, kept, strict=True)], *[df[c].alias(a) for c, a in zip(inputs, ins, strict=True)])
    schema = T.StructType([T.StructField(c, df.schema[c].dataType, True) for c in keep] + [T.StructField(f.name, f.dataType, True) for f in fields])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out = fn({c: b.column(a) for c, a in zip(inputs, ins, strict=True)})
            columns = [b.column(a) for a in kept] + [out[n] for n in names]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        release()

    return picked.mapInArrow(run, schema)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and n+1 offsets; nulls are empty."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Words are runs of other bytes than these.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True where a word begins; a text's first byte begins one unless it is white space."""
    space = IS_SPACE[data]
    before = np.empty(len(data), bool)
    before[1:] = space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    return before & ~space


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values (one per byte) by text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def count_words(column: pa.Array) -> np.ndarray:
    data, offsets = text_buffer(column)
    return per_text(word_starts(data, offsets), offsets)


def arrow_column(fn: Callable[[pa.Array], pa.Array], kind: str) -> Callable:
    """A column function from an Arrow function of one column; the row's other columns stay in the JVM."""

    def run(x: pa.Array) -> pa.Array:
        out = fn(x)
        release()
        return out

    return F.arrow_udf(run, kind)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")
