"""Notes to passages: the text kernels, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake import schema
from passagelake.functions import screen
from passagelake.text.chunking import Settings, chunk

_KERNEL = "key string, title string, indexable boolean, aliases array<string>, tags array<string>, passages array<struct<n:int,trail:array<string>,heads:array<string>,head_repeats:boolean,line:int,text:string,embed_text:string,recovered:boolean>>"


def chunked(notes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """notes (key, content, folder_in_prefix) to one row for each note with its passages as an array."""
    out = ["key", "title", "indexable", "aliases", "tags", "passages"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, content, folder in zip(f["key"], f["content"], f["folder_in_prefix"], strict=True):
                note = chunk(bytes(content) if content is not None else b"", key or "", settings, bool(folder))
                rows.append((key, note.title, note.indexable, note.aliases, note.tags, [asdict(p) for p in note.passages]))
            yield pd.DataFrame(rows, columns=out)

    return notes.select("key", "content", "folder_in_prefix").mapInPandas(run, _KERNEL)


def passages(notes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each passage, with the screen's flags."""
    one = chunked(notes, settings).select("key", "title", F.explode("passages").alias("p")).select("key", "title", "p.*")
    return one.withColumn("flags", screen.flags(F.col("text"))).select(*[c.split(" ")[0] for c in schema.PASSAGES.split(", ")])


def left_out_reason(notes: DataFrame) -> DataFrame:
    """(key, reason) of notes that cannot be indexed: index-false or empty."""
    reason = F.when(~F.col("indexable"), F.lit("index-false")).when(F.size("passages") == 0, F.lit("empty"))
    return notes.withColumn("reason", reason).filter("reason is not null").select("key", "reason")
