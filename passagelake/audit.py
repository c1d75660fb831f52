"""Named checks that prove that the index equals its source. Each is one row; all together are a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagelake.functions import numbers
from passagelake.operators.postings import doc_lengths, postings, with_tokens


def check(name: str, df: DataFrame, ok: Column, detail: Column) -> DataFrame:
    """One row from an aggregate."""
    return df.select(F.lit(name).alias("name"), ok.alias("ok"), detail.cast("string").alias("detail"))


def _none(name: str, bad: DataFrame) -> DataFrame:
    """A check that holds if a table is empty; its detail is the number of rows."""
    n = bad.agg(F.count("*").alias("n"))
    return check(name, n, F.col("n") == 0, F.col("n"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other."""
    b = b.select(*a.columns)
    counted = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    return counted.groupBy(*a.columns).agg(F.sum("_n").alias("surplus")).filter("surplus <> 0")


def checksum(df: DataFrame) -> DataFrame:
    """One row that tells two tables apart without comparing them: their number of rows and two order-free hashes."""
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("xor"), F.coalesce(F.sum(row.bitwiseAND(0xFFFFFFFF)), F.lit(0)).alias("sum"))


def passages_match(notes: DataFrame, passages: DataFrame) -> DataFrame:
    """Notes whose number of passages is not what the manifest says, either way."""
    n = passages.groupBy(F.col("key").alias("p_key")).agg(F.count("*").alias("n"))
    x = notes.join(n, notes["key"] == n["p_key"], "full_outer")
    return x.filter(~F.coalesce(F.col("passages"), F.lit(0)).eqNullSafe(F.coalesce("n", F.lit(0)))).select(F.coalesce("key", "p_key").alias("key"))


def every_id(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """(key, n, problem): passage numbers 0 to passages - 1 that are missing, and any that are over."""
    wanted = notes.filter("passages > 0").select("key", F.explode(F.sequence(F.lit(0), F.col("passages") - 1)).alias("n"))
    missing = wanted.join(ids, ["key", "n"], "left_anti").withColumn("problem", F.lit("missing"))
    over = ids.select("key", "n").join(wanted, ["key", "n"], "left_anti").withColumn("problem", F.lit("over"))
    return missing.unionByName(over)


def spot_places(total: Column, samples: int = 50) -> Column:
    """Evenly spaced places among total rows."""
    return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda s: F.floor(s * total / samples))


def spot_check(stored: DataFrame, fresh: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Vectors (key, n, vector) whose stored and fresh versions do not score 1 with each other."""
    f = fresh.select("key", "n", F.col("vector").alias("fresh"))
    return stored.join(f, ["key", "n"]).filter(F.abs(1 - numbers.cosine(F.col("vector"), F.col("fresh"))) > tolerance)


def words_match(passages: DataFrame, stored_postings: DataFrame, stored_lengths: DataFrame) -> DataFrame:
    """The saved words table against a fresh one."""
    t = with_tokens(passages, ["title", "text"], "trail")
    a = same_rows(stored_postings, postings(t, ["key", "n"])).agg(F.count("*").alias("a"))
    b = same_rows(stored_lengths, doc_lengths(t, ["key", "n"])).agg(F.count("*").alias("b"))
    return a.crossJoin(b).select((F.col("a") + F.col("b")).alias("n"))


def status(plan: DataFrame, notes: DataFrame, passages: DataFrame, vectors: DataFrame, postings_: DataFrame, lengths: DataFrame, meta: dict, settings: str) -> DataFrame:
    """The nine checks. plan: (key, action) of a shallow or deep diff."""
    spark = plan.sparkSession
    pending = plan.filter(F.col("action").isin("candidate", "added", "updated", "gone"))
    skipped = plan.filter("action = 'skipped'")
    on_disk = plan.filter(F.col("action").isin("unchanged", "touched", "updated", "candidate", "added")).select("key")
    missing = on_disk.join(notes, "key", "left_anti").unionByName(notes.select("key").join(on_disk, "key", "left_anti"))
    totals = notes.agg(F.count("*").alias("notes"), F.coalesce(F.sum("passages"), F.lit(0)).alias("passages"))
    orphans = passages.select("key").distinct().join(notes, "key", "left_anti")
    ids = passages.select("key", "n")
    versions = spark.range(1).select((F.lit(meta["settings_hash"]) == settings).alias("ok"))
    out = [
        _none("disk-matches-manifest", missing),
        _none("nothing-pending", pending),
        _none("nothing-skipped", skipped),
        check("counts-add-up", totals, (F.col("notes") == meta["notes"]) & (F.col("passages") == meta["passages"]), F.concat_ws("/", "notes", "passages")),
        _none("passages-match", passages_match(notes, passages)),
        _none("engine-current", same_rows(ids, vectors.select("key", "n"))),
        _none("exact-words-match", same_rows(ids, lengths.select("key", "n"))),
        _none("no-old-text", orphans),
        check("versions-match", versions, F.col("ok"), F.lit(settings)),
    ]
    return reduce(DataFrame.unionByName, out)


def verify(notes: DataFrame, passages: DataFrame, vectors: DataFrame, fresh: DataFrame, postings_: DataFrame, lengths: DataFrame) -> DataFrame:
    """The four deep checks; fresh: vectors embedded again for a sample."""
    words = words_match(passages, postings_, lengths)
    bad = passages.filter(F.col("text").isNull() | (F.col("n") < 0) | (F.col("line") < 1))
    out = [_none("verify-every-id", every_id(notes, vectors)), _none("verify-spot-check", spot_check(vectors, fresh)), check("verify-exact-words", words, F.col("n") == 0, F.col("n")), _none("verify-records", bad)]
    return reduce(DataFrame.unionByName, out)


def in_step(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_and("ok").alias("in_step"))
