"""A question to two ranked lists that are never fused: passages by cosine, and passages by exact words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagelake.config import clamp_count
from passagelake.embedding import Embedder
from passagelake.errors import LakeError
from passagelake.functions import links, numbers, screen, tokens
from passagelake.operators import postings as P
from passagelake.operators import vectors as V


@dataclass(frozen=True)
class Ready:
    """The tables of one snapshot: notes, passages, vectors, postings, lengths."""

    notes: DataFrame
    passages: DataFrame
    vectors: DataFrame
    postings: DataFrame
    lengths: DataFrame
    vault: str | None = None


@dataclass(frozen=True)
class Found:
    meaning: DataFrame
    exact: DataFrame
    reading: DataFrame


def passage_id(key: Column, n: Column) -> Column:
    return F.concat(key, F.lit("#"), n.cast("string"))


def parse_id(id: Column) -> tuple[Column, Column]:
    """Key and number; the number follows the last #."""
    return F.regexp_extract(id, r"(?s)\A(.*)#[^#]*\z", 1), F.regexp_extract(id, r"#([^#]*)\z", 1).cast("int")


def meaning_list(ready: Ready, questions: list[str], count: int, embedder: Embedder) -> DataFrame:
    """(key, n, score, more): the best passage of each note over all wordings."""
    spark = ready.notes.sparkSession
    queries = embedder.embed(questions)
    known = ready.notes.select("key", F.col("passages").alias("known_passages"))
    live = ready.vectors.join(known, "key").filter("n >= 0 and n < known_passages").drop("known_passages")
    rows = spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(queries)], "wording int, query array<double>")
    live = live.withColumn("id", F.struct("key", "n"))

    def fetch(k: int) -> DataFrame:
        return V.top_k(live, rows, k, "id").select("wording", F.col("id.key").alias("key"), F.col("id.n").alias("n"), "score", "rank")

    return V.adaptive(fetch, "key", "n", count)


def exact_list(ready: Ready, questions: list[str]) -> DataFrame:
    """(key, n, score, words, wording, place): passages that hold the words, and the quoted phrases, of a wording."""
    spark = ready.notes.sparkSession
    terms = P.question_terms(spark, questions)
    read = [tokens.read_question(q) for q in questions]
    asked = spark.createDataFrame([(i, r["words"], [" ".join(p) for p in r["phrases"]]) for i, r in enumerate(read)], "wording int, asked array<string>, phrases array<string>")
    ranked = P.rank(ready.postings, ready.lengths, terms, ["key", "n"])
    x = ranked.join(ready.passages.select("key", "n", "title", "trail", "text"), ["key", "n"]).join(F.broadcast(asked), "wording")
    fields = F.concat(F.array(F.coalesce("title", F.lit(""))), F.coalesce("trail", F.array().cast("array<string>")), F.array("text"))
    held = F.transform(fields, tokens.tokenise)
    spaced = F.transform(held, lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")))
    every = F.forall("phrases", lambda p: F.exists(spaced, lambda s: F.contains(s, F.concat(F.lit(" "), p, F.lit(" ")))))
    words = F.array_intersect("asked", F.array_distinct(F.flatten(held)))
    x = x.withColumn("words", words).withColumn("ok", every & (F.size(words) > 0))
    placed = P.examined(x.select("wording", "key", "n", "score", "words", "ok"), "key", "ok", [F.col("score").desc(), F.col("key"), F.col("n")])
    return P.merge_wordings(placed, "key").select("key", "n", "score", "words", "wording", "place")


def shaped(hits: DataFrame, ready: Ready) -> DataFrame:
    """What a result shows; texts are fetched for the winners alone, with secrets masked."""
    p = ready.passages.select("key", "n", "title", "trail", "heads", "head_repeats", "line", "text", "recovered", "flags")
    x = hits.join(p, ["key", "n"])
    text = screen.mask_secrets(F.col("text"))
    link = links.build_link(F.lit(ready.vault).cast("string"), F.col("key"), F.col("heads"), F.col("head_repeats"), F.col("recovered"))
    return x.select(*hits.columns, F.col("title").alias("note"), F.array_join("trail", " > ").alias("section"), "line", link.alias("link"), links.snippet(text).alias("snippet"), text.alias("text"), "flags")


def reading(shown: DataFrame, passages: DataFrame) -> DataFrame:
    """One row: passages and words shown, their notes, and the words of those notes, each note once."""
    words = links.count_words(F.col("text")).cast("long")
    a = shown.agg(F.count("*").alias("passages"), F.coalesce(F.sum(words), F.lit(0)).alias("words"), F.count_distinct("key").alias("notes"))
    b = passages.join(shown.select("key").distinct(), "key", "left_semi").agg(F.coalesce(F.sum(words), F.lit(0)).alias("note_words"))
    return a.crossJoin(b)


def search(ready: Ready, questions: list[str], embedder: Embedder, count: int | None = None, exact_words: bool = True) -> Found:
    """Both lists and the reading counts. The first list does not depend on whether the second is asked for."""
    questions = [q.strip() for q in questions if q.strip()]
    if not questions:
        raise LakeError("USAGE")
    count = clamp_count(count)
    first = meaning_list(ready, questions, count, embedder)
    first = first.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "key")))  # at most most_count rows
    meaning = shaped(first, ready).withColumn("score", numbers.half_up(F.col("score"), 3))
    if exact_words:
        hits = P.not_already_shown(exact_list(ready, questions), meaning, ["key", "n"], [F.col("place"), F.col("score").desc(), F.col("wording")])
        hits = hits.withColumn("rank", F.row_number().over(W.orderBy("place", F.desc("score"), "wording")))  # at most three rows
        exact = shaped(hits, ready).withColumn("score", numbers.half_up(F.col("score"), 2))
    else:
        exact = shaped(ready.passages.select("key", "n").limit(0), ready)
    both = meaning.select("key", "n", "text").unionByName(exact.select("key", "n", "text"))
    return Found(meaning, exact, reading(both, ready.passages))
