"""Snapshot diff: the notes on disk against the notes in the index.

Two steps. shallow() compares sizes and dates only, so that nothing is read. deep() takes the
hashes of what shallow() called a candidate and settles each key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagelake.errors import LakeError

# A date this close to now may still change unseen; a sync that loses more than both of these stops.
RACY_MS, MOST_LEAVING, MOST_SHARE = 2000, 10, 0.2


def note_hash(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 16)


def base_name(key: Column) -> Column:
    return F.lower(F.element_at(F.split(key, "/"), -1))


def with_folder_flag(notes: DataFrame) -> DataFrame:
    """notes with folder_in_prefix: another note has the same file name, in any case."""
    return notes.withColumn("folder_in_prefix", F.count("*").over(W.partitionBy(base_name(F.col("key")))) > 1)


def racy(now_ms: Column, mtime_ms: Column) -> Column:
    return F.abs(now_ms - mtime_ms) < RACY_MS


def shallow(disk: DataFrame, manifest: DataFrame, kept: DataFrame | None = None, ignore_racy: bool = False) -> DataFrame:
    """(key, state, ...): unchanged, candidate, left-out (as remembered) or gone.

    disk: key, size, mtime_ms, folder_in_prefix. manifest: as MANIFEST_NOTES. kept: as LEFT_OUT_KEPT.
    """
    m = manifest.select(*[F.col(c).alias(f"m_{c}") for c in manifest.columns])
    x = disk.join(m, disk["key"] == m["m_key"], "full_outer")
    there = F.col("m_key").isNotNull()
    same = there & (F.col("m_size") == F.col("size")) & (F.col("m_mtime_ms") == F.col("mtime_ms")) & (F.col("m_folder_in_prefix") == F.col("folder_in_prefix"))
    same &= F.lit(True) if ignore_racy else ~F.coalesce(F.col("m_racy"), F.lit(False))
    reason = F.lit(None).cast("string")
    if kept is not None:
        k = kept.select(*[F.col(c).alias(f"k_{c}") for c in kept.columns])
        x = x.join(k, note_hash(F.col("key")) == F.col("k_note_hash"), "left")
        remembered = F.col("k_note_hash").isNotNull() & (F.col("k_size") == F.col("size")) & (F.col("k_mtime_ms") == F.col("mtime_ms"))
        remembered &= F.lit(True) if ignore_racy else ~F.coalesce(F.col("k_racy"), F.lit(False))
        reason = F.when(~there & remembered, F.col("k_reason"))
    state = F.when(F.col("key").isNull(), F.lit("gone")).when(same, F.lit("unchanged")).when(reason.isNotNull(), F.lit("left-out")).otherwise(F.lit("candidate"))
    return x.select(F.coalesce("key", "m_key").alias("key"), state.alias("state"), reason.alias("reason"), "size", "mtime_ms", "folder_in_prefix", "m_sha256", "m_passages", "m_folder_in_prefix")


def deep(states: DataFrame, hashes: DataFrame) -> DataFrame:
    """(key, action, ...): unchanged, touched, updated, added, left-out, gone or skipped.

    hashes: key, sha256, problem (null if the note could be read) of the candidates.
    """
    h = hashes.select(F.col("key").alias("h_key"), "sha256", "problem")
    x = states.join(h, states["key"] == h["h_key"], "left")
    action = (
        F.when(F.col("state") != "candidate", F.col("state"))
        .when(F.col("problem").isNotNull(), F.lit("skipped"))
        .when(F.col("m_sha256").isNull(), F.lit("added"))
        .when((F.col("m_sha256") == F.col("sha256")) & (F.col("m_folder_in_prefix") == F.col("folder_in_prefix")), F.lit("touched"))
        .otherwise(F.lit("updated"))
    )
    return x.withColumn("action", action).drop("h_key", "state")  # keeps problem: a note that waits for its download keeps its passages


def under(key: Column, folder: Column) -> Column:
    """Whether a key lies in a folder, by whole path segments; "." holds everything."""
    return (folder == ".") | F.startswith(key, F.concat(folder, F.lit("/")))


def excluded(key: Column, entry: Column) -> Column:
    """The same without regard to case, or the entry itself."""
    k, x = F.lower(key), F.lower(entry)
    return (k == x) | F.startswith(k, F.concat(x, F.lit("/")))


def removed(gone: DataFrame, unreadable: list[str]) -> DataFrame:
    """Keys that left, but for those below a folder that could not be read: those are skipped."""
    spark = gone.sparkSession
    dirs = spark.createDataFrame([(d,) for d in unreadable], "folder string")
    return gone.join(F.broadcast(dirs), under(gone["key"], dirs["folder"]), "left_anti")


def renames(added: DataFrame, gone: DataFrame, sha: str = "sha256") -> DataFrame:
    """(from_key, to_key): equal contents paired one to one, first with first, in the order of position.

    added, gone: key, sha, pos. A content that both sides hold many times is paired by rank within it.
    """
    by = W.partitionBy(sha).orderBy("pos")
    a = added.select(F.col(sha), F.col("key").alias("to_key"), F.row_number().over(by).alias("rn"))
    g = gone.select(F.col(sha), F.col("key").alias("from_key"), F.row_number().over(by).alias("rn"))
    return g.join(a, [sha, "rn"]).select("from_key", "to_key")


@dataclass(frozen=True)
class Counts:
    indexed: int
    eligible: int
    added: int
    updated: int
    renamed: int
    removed: int
    dropped: int
    unchanged: int

    @property
    def leaving(self) -> int:
        return self.removed - self.renamed + self.dropped


def stop_reason(indexed: Column, found: Column, leaving: Column) -> Column:
    """Why a sync must not go on: the source is empty, or too much would leave."""
    mass = (leaving > MOST_LEAVING) & (leaving > indexed * MOST_SHARE)
    return F.when((found == 0) & (indexed > 0), F.lit("SOURCE_EMPTY")).when(mass, F.lit("MASS_DELETE"))


def check_safety(c: Counts, path: str = "", allow_mass_delete: bool = False) -> None:
    if c.eligible == 0 and c.indexed > 0:
        raise LakeError("SOURCE_EMPTY", path=path, indexed=c.indexed)
    if not allow_mass_delete and c.leaving > MOST_LEAVING and c.leaving > c.indexed * MOST_SHARE:
        raise LakeError("MASS_DELETE", count=c.leaving)
