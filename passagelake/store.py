"""Snapshots: versioned Parquet folders with a pointer that is switched in one rename.

    <base>/CURRENT            name of the snapshot that counts
    <base>/data-000001/notes, passages, vectors, postings, lengths, left_out, meta

A snapshot is written whole before the pointer moves, so a crash leaves the old one readable, and
what the pointer does not name is litter. Every sync is a compaction: only live records are carried.
"""

from __future__ import annotations

import os
import shutil
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelake import schema
from passagelake.config import write_atomic
from passagelake.errors import LakeError

TABLES = {"notes": schema.MANIFEST_NOTES, "passages": schema.PASSAGES, "vectors": schema.VECTORS, "postings": schema.POSTINGS, "lengths": schema.DOC_STATS, "left_out": schema.LEFT_OUT_KEPT, "meta": schema.MANIFEST_META}


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    @property
    def pointer(self) -> str:
        return os.path.join(self.base, "CURRENT")

    def current(self) -> str | None:
        try:
            with open(self.pointer, encoding="utf-8") as f:
                return f.read().strip() or None
        except FileNotFoundError:
            return None

    def path(self, table: str, snapshot: str | None = None) -> str:
        return os.path.join(self.base, snapshot or self.current() or "", table)

    def read(self, table: str) -> DataFrame:
        """A table of the current snapshot; an empty one if there is none."""
        now = self.current()
        if now is None:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(self.path(table, now))

    def meta(self) -> dict | None:
        rows = self.read("meta").collect()
        if not rows:
            return None
        if rows[0]["schema"] > schema.SCHEMA:
            raise LakeError("MANIFEST_NEWER")
        return rows[0].asDict()

    def next_name(self) -> str:
        taken = [int(n[5:]) for n in (os.listdir(self.base) if os.path.isdir(self.base) else []) if n.startswith("data-") and n[5:].isdigit()]
        return f"data-{max(taken, default=0) + 1:06d}"

    def commit(self, tables: dict[str, DataFrame], content_changed: bool = True, still_ours: Callable[[], bool] = lambda: True) -> str:
        """Write a snapshot and switch to it. The stamp goes up only if passages changed. `meta` is completed here."""
        before = self.meta()
        name = self.next_name()
        for t, df in tables.items():
            if t != "meta":
                df.write.parquet(self.path(t, name))
        notes = self.spark.read.schema(TABLES["notes"]).parquet(self.path("notes", name))
        total = notes.agg(F.count("*").alias("notes"), F.coalesce(F.sum("passages"), F.lit(0)).alias("passages")).first()
        stamp = (before["stamp"] if before else 0) + bool(content_changed)
        told = tables["meta"].first().asDict() | {"schema": schema.SCHEMA, "stamp": stamp, "notes": total["notes"], "passages": total["passages"]}
        self.spark.createDataFrame([told], schema.MANIFEST_META).coalesce(1).write.parquet(self.path("meta", name))
        if not still_ours():
            shutil.rmtree(os.path.join(self.base, name))
            raise LakeError("LOCK_LOST")
        write_atomic(self.pointer, name)
        return name

    def remove_orphans(self) -> list[str]:
        """Snapshots that the pointer does not name."""
        now = self.current()
        old = [n for n in sorted(os.listdir(self.base)) if n.startswith("data-") and n != now] if os.path.isdir(self.base) else []
        for n in old:
            shutil.rmtree(os.path.join(self.base, n))
        return old

    def live(self, work: Callable[[], object]):
        """Run work; once more if the snapshot was replaced while it ran."""
        before = self.current()
        try:
            return work()
        except Exception:
            if self.current() == before:
                raise
            return work()

    @contextmanager
    def lock(self, wait_s: float = 0):
        """Only one sync at a time; yields a test whether the lock is still ours. A lock whose process is gone is taken over."""
        os.makedirs(self.base, exist_ok=True)
        path = os.path.join(self.base, "sync.lock")
        token = f"{os.getpid()} {time.time_ns()}"
        until = time.time() + wait_s
        while True:
            try:
                handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                os.write(handle, token.encode())
                os.close(handle)
                break
            except FileExistsError:
                if self._stale(path):
                    os.unlink(path)
                elif time.time() >= until:
                    raise LakeError("BUSY") from None
                else:
                    time.sleep(0.5)

        def ours() -> bool:
            try:
                with open(path, encoding="utf-8") as f:
                    return f.read() == token
            except FileNotFoundError:
                return False

        try:
            yield ours
        finally:
            if ours():
                os.unlink(path)

    @staticmethod
    def _stale(path: str) -> bool:
        try:
            with open(path, encoding="utf-8") as f:
                pid = int(f.read().split()[0])
            os.kill(pid, 0)
        except (ProcessLookupError, ValueError, IndexError):
            return True
        except (FileNotFoundError, PermissionError):
            return False
        return False


def scan_log(lines: DataFrame) -> DataFrame:
    """(offset, record, path, op) of a JSON-lines log up to its first torn or invalid line. lines: offset, value."""
    from passagelake.operators.ordered import complete_prefix

    parsed = lines.withColumn("record", F.from_json("value", "op string, path string, sha256 string, size bigint, mtime_ms bigint, passages int, note int, dims int", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}))
    good = F.coalesce(F.col("record.op").isin("header", "put", "del"), F.lit(False))
    return complete_prefix(parsed, "offset", good).select("offset", "record.*")


def recover(manifest: DataFrame, log: DataFrame, checkpoint: int) -> DataFrame:
    """The manifest with the log's records past the checkpoint folded in: the last record of a path counts; recovered notes are racy."""
    from passagelake.operators.ordered import last_record_wins

    late = log.filter((F.col("offset") > checkpoint) & F.col("op").isin("put", "del"))
    puts = last_record_wins(late, "path", "offset", "op").select(F.col("path").alias("key"), "sha256", "size", "mtime_ms", F.lit(True).alias("racy"), "passages", F.lit(False).alias("folder_in_prefix"), F.lit(0).alias("flagged"), F.lit(None).cast("string").alias("file"))
    kept = manifest.join(late.select(F.col("path").alias("key")).distinct(), "key", "left_anti")
    return kept.unionByName(puts)
