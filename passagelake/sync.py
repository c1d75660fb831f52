"""Make the index equal the folder: walk, diff, safety stops, read and chunk what changed, write a snapshot, switch."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelake import audit, config, schema
from passagelake.embedding import Embedder, HashingEmbedder, embedded
from passagelake.errors import LakeError
from passagelake.functions import screen
from passagelake.operators.notes import chunked, left_out_reason
from passagelake.operators.postings import doc_lengths, postings, with_tokens
from passagelake.plans import diff
from passagelake.search import Ready
from passagelake.sources import folder
from passagelake.store import Store
from passagelake.text.chunking import CHUNKER_VERSION, Settings


@dataclass
class Summary:
    added: int
    updated: int
    renamed: int
    removed: int
    unchanged: int
    touched: int
    left_out: int
    skipped: int
    other_files: int
    snapshot: str | None
    warnings: list[str]


def settings_of(c: config.Config) -> Settings:
    return Settings(budget=c.budget_tokens, min_words=c.min_words, drop_fences=c.drop_fences)


def plan(spark: SparkSession, store: Store, root: str, c: config.Config, ignore_racy: bool = False) -> tuple[DataFrame, DataFrame, folder.Walk]:
    """(notes on disk, states, walk) of a shallow look: nothing is read."""
    found = folder.walk(root, c.exclude)
    notes, _ = folder.tables(spark, found)
    disk = diff.with_folder_flag(notes)
    return disk, diff.shallow(disk.select("key", "size", "mtime_ms", "folder_in_prefix"), store.read("notes"), store.read("left_out"), ignore_racy), found


def sync(spark: SparkSession, root: str, base: str, c: config.Config = config.Config(), embedder: Embedder | None = None, allow_mass_delete: bool = False, full: bool = False, now_ms: int | None = None) -> Summary:
    """Bring the index at base in step with the folder at root. full begins from an empty index."""
    embedder = embedder or HashingEmbedder(c.dimensions)
    now_ms = int(time.time() * 1000) if now_ms is None else now_ms
    config.check_index_outside(base, root)
    store = Store(spark, base)
    with store.lock() as ours:
        store.remove_orphans()
        meta, told = store.meta(), config.settings_hash(c)
        fresh = full or meta is None or meta["settings_hash"] != told or meta["model"] != embedder.name or meta["chunker_version"] != CHUNKER_VERSION
        manifest = store.read("notes") if not fresh else spark.createDataFrame([], schema.MANIFEST_NOTES)
        kept = store.read("left_out") if not fresh else spark.createDataFrame([], schema.LEFT_OUT_KEPT)
        found = folder.walk(root, c.exclude)
        notes, _ = folder.tables(spark, found)
        disk = diff.with_folder_flag(notes).cache()
        states = diff.shallow(disk.select("key", "size", "mtime_ms", "folder_in_prefix"), manifest, kept)
        candidates = disk.join(states.filter("state = 'candidate'").select("key"), "key", "left_semi")
        read = folder.read_notes(candidates).join(disk.select("key", "folder_in_prefix"), "key").persist()
        settled = diff.deep(states, read.select("key", "sha256", "problem")).persist()
        made = chunked(read.join(settled.filter(F.col("action").isin("added", "updated")).select("key"), "key", "left_semi"), settings_of(c)).persist()
        out = left_out_reason(made).persist()
        if settled.filter("problem = 'not-downloaded'").count() >= folder.MOST_TIMEOUTS:
            raise LakeError("SOURCE_DOWNLOADING")
        n = {r["action"]: r["n"] for r in settled.groupBy("action").agg(F.count("*").alias("n")).collect()}
        gone = settled.filter("action = 'gone'")
        hidden = {k for k, reason, *_ in found.left_out if reason == "not-downloaded"}
        waiting = spark.createDataFrame([(k,) for k in hidden], "key string")
        left = diff.removed(gone, found.unreadable).join(F.broadcast(waiting), "key", "left_anti").persist()
        dropped = out.join(manifest.select("key"), "key", "left_semi").count()
        fresh_keys = made.join(out, "key", "left_anti").select("key")
        new = settled.filter("action = 'added'").join(fresh_keys, "key", "left_semi")
        pairs = diff.renames(new.select("key", "sha256", F.col("key").alias("pos")), left.select("key", F.col("m_sha256").alias("sha256"), F.col("key").alias("pos")))
        renamed, removed, n_out = pairs.count(), left.count(), out.count()
        indexed = manifest.count()
        eligible = disk.count() - n_out
        counts = diff.Counts(indexed, eligible, n.get("added", 0), n.get("updated", 0), renamed, removed, dropped, n.get("unchanged", 0))
        diff.check_safety(counts, root, allow_mass_delete)

        texts = made.join(out, "key", "left_anti").select("key", "title", F.explode("passages").alias("p")).select("key", "title", "p.*").withColumn("flags", screen.flags(F.col("text"))).select(*[x.split(" ")[0] for x in schema.PASSAGES.split(", ")])
        stale = left.select("key").unionByName(made.select("key"))
        keep = lambda t: store.read(t).join(stale, "key", "left_anti") if not fresh else spark.createDataFrame([], STORE_SCHEMA[t])
        terms = with_tokens(texts, ["title", "text"], "trail")
        passages = keep("passages").unionByName(texts)
        per_note = texts.groupBy("key").agg(F.count("*").cast("int").alias("passages"), F.count_if(F.size("flags") > 0).cast("int").alias("flagged"))
        made_notes = per_note.join(read.select("key", "sha256"), "key").join(disk.select("key", "size", "mtime_ms", "folder_in_prefix", "file"), "key")
        made_notes = made_notes.withColumn("racy", diff.racy(F.lit(now_ms), F.col("mtime_ms"))).withColumn("file", F.when(F.col("file") != F.col("key"), F.col("file")))
        touched = manifest.join(settled.filter("action = 'touched'").select("key", F.col("size").alias("new_size"), F.col("mtime_ms").alias("new_ms")), "key")
        touched = touched.withColumns({"size": F.col("new_size"), "mtime_ms": F.col("new_ms"), "racy": diff.racy(F.lit(now_ms), F.col("new_ms"))})
        columns = [x.split(" ")[0] for x in schema.MANIFEST_NOTES.split(", ")]
        kept_notes = manifest.join(stale, "key", "left_anti").join(touched.select("key"), "key", "left_anti")
        all_notes = kept_notes.select(*columns).unionByName(touched.select(*columns)).unionByName(made_notes.select(*columns))
        memory = out.join(disk.select("key", "size", "mtime_ms"), "key").select(diff.note_hash(F.col("key")).alias("note_hash"), "reason", "size", "mtime_ms", diff.racy(F.lit(now_ms), F.col("mtime_ms")).alias("racy"))
        remembered = settled.filter("action = 'left-out'").select(diff.note_hash(F.col("key")).alias("note_hash"))
        memory = kept.join(remembered, "note_hash", "left_semi").unionByName(memory)
        changed = bool(n.get("added", 0) + n.get("updated", 0) + removed)
        meta_row = spark.createDataFrame([(schema.SCHEMA, 0, CHUNKER_VERSION, told, embedder.name, embedder.dimensions, 0, 0)], schema.MANIFEST_META)
        snapshot = None
        if changed or fresh or n.get("touched", 0) or n_out:
            snapshot = store.commit({"notes": all_notes, "passages": passages, "vectors": keep("vectors").unionByName(embedded(texts, embedder)), "postings": keep("postings").unionByName(postings(terms, ["key", "n"])), "lengths": keep("lengths").unionByName(doc_lengths(terms, ["key", "n"])), "left_out": memory, "meta": meta_row}, changed or fresh, ours)
            store.remove_orphans()
        summary = Summary(n.get("added", 0) - n_out + dropped - renamed, n.get("updated", 0) - dropped, renamed, removed + dropped - renamed, n.get("unchanged", 0), n.get("touched", 0), n_out + n.get("left-out", 0) + len(found.left_out), n.get("skipped", 0) + len(found.unreadable), found.other_files, snapshot, found.warnings + [f"exclude entry matched nothing: {u}" for u in found.unmatched])
        for x in (disk, read, settled, made, out, left):
            x.unpersist()
        return summary


STORE_SCHEMA = {"passages": schema.PASSAGES, "vectors": schema.VECTORS, "postings": schema.POSTINGS, "lengths": schema.DOC_STATS}


def ready(spark: SparkSession, base: str, vault: str | None = None) -> Ready:
    """The current snapshot, for search()."""
    store = Store(spark, base)
    if store.current() is None:
        raise LakeError("NOT_SYNCED")
    return Ready(*(store.read(t) for t in ("notes", "passages", "vectors", "postings", "lengths")), vault)


def status(spark: SparkSession, root: str, base: str, c: config.Config = config.Config()) -> DataFrame:
    """The nine checks over a shallow look at the folder."""
    store = Store(spark, base)
    _, states, _ = plan(spark, store, root, c, ignore_racy=True)
    return audit.status(states.withColumn("action", F.col("state")).filter("state <> 'left-out'"), *(store.read(t) for t in ("notes", "passages", "vectors", "postings", "lengths")), store.meta(), config.settings_hash(c))


def verify(spark: SparkSession, base: str, embedder: Embedder, samples: int = 50) -> DataFrame:
    """The four deep checks; a sample of passages is embedded again."""
    store = Store(spark, base)
    passages = store.read("passages")
    fresh = embedded(passages.orderBy(F.xxhash64("key", "n")).limit(samples), embedder)
    return audit.verify(store.read("notes"), passages, store.read("vectors"), fresh, store.read("postings"), store.read("lengths"))


def rebuild(spark: SparkSession, base: str, embedder: Embedder) -> str:
    """Make the derived tables anew from the saved passages."""
    store = Store(spark, base)
    passages = store.read("passages")
    terms = with_tokens(passages, ["title", "text"], "trail")
    return store.commit({"notes": store.read("notes"), "passages": passages, "vectors": embedded(passages, embedder), "postings": postings(terms, ["key", "n"]), "lengths": doc_lengths(terms, ["key", "n"]), "left_out": store.read("left_out"), "meta": store.read("meta")}, False)
