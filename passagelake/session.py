"""What a session needs before it runs this package's operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver found it.

    On a cluster whose nodes don't share that folder, install the package or pass it with --py-files.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(p for p in [*paths, ROOT] if p)
    return spark


#: The temporary folder of sessions on one machine that name none.
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    A session on this machine alone (as in a test) gets a temporary one if none is named; on a cluster it must be named.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="passagelake-"))
            atexit.register(shutil.rmtree, _own[0].removeprefix("file://"), ignore_errors=True)
        found = _own[0]
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared checkpoint folder, and read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/passagelake/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local(cores: int | str = 8, memory: str = "8g", **settings: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("passagelake")
    base = {"spark.ui.enabled": "false", "spark.driver.memory": memory, "spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    for k, v in (base | settings).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
