"""Documents that arrive in a landing folder, folded into a snapshot table batch by batch.

The state is the table itself: a batch is an upsert by key where the last record counts, so that a
batch that is delivered twice changes nothing. Each batch writes a snapshot and switches to it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelake.config import write_atomic
from passagelake.operators.ordered import last_record_wins

LANDING = "op string, key string, text string, version bigint"


def current(spark: SparkSession, base: str) -> DataFrame:
    try:
        with open(os.path.join(base, "CURRENT"), encoding="utf-8") as f:
            return spark.read.schema("key string, text string, version bigint").parquet(os.path.join(base, f.read().strip()))
    except FileNotFoundError:
        return spark.createDataFrame([], "key string, text string, version bigint")


def fold(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state after a batch of puts and dels; older versions than the state's are ignored."""
    log = state.select(F.lit("put").alias("op"), "key", "text", "version").unionByName(batch.select("op", "key", "text", "version"))
    return last_record_wins(log, "key", "version", "op").select("key", "text", "version")


def start(spark: SparkSession, landing: str, base: str, checkpoint: str):
    """A query that takes what has landed and stops; call it again for more."""

    def one(batch: DataFrame, number: int) -> None:
        name = f"data-{number:09d}"
        fold(current(spark, base), batch).write.mode("overwrite").parquet(os.path.join(base, name))
        write_atomic(os.path.join(base, "CURRENT"), name)

    stream = spark.readStream.schema(LANDING).json(landing)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
