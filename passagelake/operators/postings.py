"""The inverted table and BM25: build, statistics, ranking, phrases, merging of wordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagelake.functions import numbers, tokens

# What the table's columns saturate at, and the limits of the exact list.
MOST_TF, MOST_LENGTH, MOST_WORDS, PER_WORDING, EXAMINED, SHOWN = 255, 65535, 255, 3, 300, 3


def with_tokens(passages: DataFrame, fields: list[str], trail: str | None = None) -> DataFrame:
    """passages with `terms`: the distinctive tokens of all fields (a null field holds none)."""
    parts = [tokens.tokenise(F.coalesce(F.col(f), F.lit(""))) for f in fields]
    if trail:
        parts.append(F.flatten(F.transform(F.coalesce(F.col(trail), F.array().cast("array<string>")), tokens.tokenise)))
    return passages.withColumn("terms", tokens.distinctive(F.concat(*parts)))


def doc_lengths(tokenised: DataFrame, keys: list[str]) -> DataFrame:
    return tokenised.select(*keys, F.least(F.size("terms"), F.lit(MOST_LENGTH)).cast("int").alias("doc_len"))


def postings(tokenised: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, tf): one row for each term of each passage, summed up before the shuffle."""
    exploded = tokenised.select(*keys, F.explode("terms").alias("term"))
    return exploded.groupBy(*keys, "term").agg(F.least(F.count("*"), F.lit(MOST_TF)).cast("int").alias("tf"))


def postings_of(tokenised: DataFrame, keys: list[str], words: list[str]) -> DataFrame:
    """postings() of a question's words alone, counted inside each row: no shuffle, and no row for any other term."""
    if len(words) > MOST_WORDS:
        raise ValueError(f"at most {MOST_WORDS} words")
    asked = F.filter("terms", lambda t: t.isin(*words))
    tf = lambda w: F.least(F.size(F.filter("asked", lambda t: t == w)), F.lit(MOST_TF))
    counted = F.transform(F.array_distinct("asked"), lambda t: F.struct(t.alias("term"), tf(t).alias("tf")))
    return tokenised.select(*keys, asked.alias("asked")).filter(F.size("asked") > 0).select(*keys, F.explode(counted).alias("p")).select(*keys, "p.term", "p.tf")


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: passages, sum_len and avg_len (0 for none)."""
    x = lengths.agg(F.count("*").alias("passages"), F.coalesce(F.sum(F.col("doc_len").cast("long")), F.lit(0)).alias("sum_len"))
    return x.withColumn("avg_len", F.when(F.col("passages") > 0, F.col("sum_len") / F.col("passages")).otherwise(0.0))


def question_terms(spark, wordings: list[str]) -> DataFrame:
    """(wording, term, required) of at most MOST_WORDS words; a word of a quoted phrase is required."""
    seen: dict[str, None] = {}
    rows = []
    for i, q in enumerate(wordings):
        read = tokens.read_question(q)
        needed = {t for p in read["phrases"] for t in p if tokens.distinctive_of(t)}
        for w in read["words"]:
            seen.setdefault(w)
            if list(seen).index(w) < MOST_WORDS:
                rows.append((i, w, w in needed))
    return spark.createDataFrame(rows, "wording int, term string, required boolean")


def rank(post: DataFrame, lengths: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """(wording, keys, score, held): BM25 of every passage that holds a term, and all required ones.

    terms is a question, at most MOST_WORDS rows for each wording, so it is broadcast; one pass
    over the table serves all wordings. Lengths are joined for the passages that hit alone.
    """
    stats = corpus_stats(lengths)
    distinct = terms.select("term").distinct()
    hits = post.join(F.broadcast(distinct), "term")
    df = hits.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))
    weights = df.select("term", numbers.idf(F.col("passages"), F.col("df")).alias("weight"), "avg_len")
    needed = terms.groupBy("wording").agg(F.count_if("required").alias("n_required"))
    asked = terms.join(weights, "term").join(needed, "wording")
    scored = hits.join(F.broadcast(asked), "term").join(lengths, keys)
    value = numbers.term_score(F.col("weight"), F.col("tf"), F.col("doc_len"), F.col("avg_len"))
    out = scored.groupBy("wording", *keys).agg(F.sum(value).alias("score"), F.count_if("required").alias("held"), F.first("n_required").alias("n_required"))
    return out.filter("held = n_required").drop("n_required", "held")


def rank_rows(tokenised: DataFrame, keys: list[str], wordings: list[str]) -> DataFrame:
    """(keys, wording, score): rank() straight from texts, without a table of postings.

    One aggregate over all rows gives the passages, their average length and each word's document
    frequency; with that one row at hand each passage scores itself. Nothing is shuffled.
    """
    asked = [tokens.read_question(q) for q in wordings]
    words = list(dict.fromkeys(w for q in asked for w in q["words"]))[:MOST_WORDS]
    if not words:
        return tokenised.select(*keys, F.lit(0).alias("wording"), F.lit(0.0).alias("score")).limit(0)
    held = F.filter("terms", lambda t: t.isin(*words))
    narrow = tokenised.select(*keys, F.least(F.size("terms"), F.lit(MOST_LENGTH)).alias("doc_len"), held.alias("held"))
    stats = narrow.agg(F.count("*").alias("passages"), F.avg("doc_len").alias("avg_len"), F.array(*[F.count_if(F.array_contains("held", w)) for w in words]).alias("df"))
    x = narrow.filter(F.size("held") > 0).crossJoin(F.broadcast(stats))
    same = lambda w: lambda t: t == w
    tf = {w: F.least(F.size(F.filter("held", same(w))), F.lit(MOST_TF)) for w in words}
    x = x.withColumns({f"_s{i}": F.when(F.array_contains("held", w), numbers.term_score(numbers.idf(F.col("passages"), F.col("df")[i]), tf[w], F.col("doc_len"), F.col("avg_len"))).otherwise(0.0) for i, w in enumerate(words)})
    scores = []
    for i, q in enumerate(asked):
        mine = [w for w in q["words"] if w in words]
        needed = [w for p in q["phrases"] for w in p if w in mine]
        ok = F.arrays_overlap("held", F.lit(mine)) if mine else F.lit(False)
        for w in needed:
            ok = ok & F.array_contains("held", w)
        total = sum((F.col(f"_s{words.index(w)}") for w in mine), F.lit(0.0))
        scores.append(F.when(ok, F.struct(F.lit(i).alias("wording"), total.alias("score"))))
    found = x.select(*keys, F.explode(F.filter(F.array(*scores), lambda s: s.isNotNull())).alias("r"))
    return found.select(*keys, "r.wording", "r.score")


def best_of_note(ranked: DataFrame, note: str, order: list[Column], per: list[str] | None = None) -> DataFrame:
    """The best row of each note (and wording): strictly better replaces, so ties go to the order's later columns."""
    by = W.partitionBy(*(per or []), note).orderBy(*order)
    return ranked.withColumn("_place", F.row_number().over(by)).filter("_place = 1").drop("_place")


def examined(candidates: DataFrame, note: str, ok: str, order: list[Column]) -> DataFrame:
    """Per wording the verified candidates that a reader meets who stops after EXAMINED checks and takes PER_WORDING notes.

    A candidate is checked unless its note was taken by a better one; of each note the first that
    holds is taken.
    """
    ranked = candidates.withColumn("rank", F.row_number().over(W.partitionBy("wording").orderBy(*order)))
    first = F.min(F.when(F.col(ok), F.col("rank"))).over(W.partitionBy("wording", note))
    met = ranked.withColumn("first_ok", first).filter(F.col("first_ok").isNull() | (F.col("rank") <= F.col("first_ok")))
    met = met.withColumn("checked", F.row_number().over(W.partitionBy("wording").orderBy("rank")))
    taken = met.filter((F.col("rank") == F.col("first_ok")) & (F.col("checked") <= EXAMINED))
    placed = taken.withColumn("place", F.row_number().over(W.partitionBy("wording").orderBy("rank")) - 1)
    return placed.filter(F.col("place") < PER_WORDING).drop("rank", "first_ok", "checked")


def merge_wordings(placed: DataFrame, note: str) -> DataFrame:
    """Of each note the best place over all wordings, then score, then wording."""
    return best_of_note(placed, note, [F.col("place"), F.col("score").desc(), F.col("wording")])


def not_already_shown(hits: DataFrame, shown: DataFrame, keys: list[str], order: list[Column], most: int = SHOWN) -> DataFrame:
    """Hits whose passage is not in the other list; the first few."""
    return hits.join(shown.select(*keys).distinct(), keys, "left_anti").orderBy(*order).limit(most)
