"""Exact vector search and the collapse of passages to notes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagelake.functions import numbers

#: Queries in one call: they go to every task, so their number is bounded.
MOST_QUERIES = 10_000


def scored(vectors: DataFrame, queries: DataFrame, vector: str = "vector") -> DataFrame:
    """Each vector with each query's score, as expressions. queries: (wording, query)."""
    x = vectors.crossJoin(F.broadcast(queries))
    return x.withColumn("score", numbers.cosine(F.col(vector), F.col("query"))).drop("query")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id: str, vector: str = "vector") -> DataFrame:
    """(wording, id, score, rank): the k best of each wording, by score and then id.

    Spark keeps the k best of each wording in every task before it shuffles.
    """
    by = W.partitionBy("wording").orderBy(F.col("score").desc(), F.col(id))
    return scored(vectors, queries, vector).select("wording", id, "score").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def top_k_blocks(vectors: DataFrame, queries: DataFrame, k: int, id: str, vector: str = "vector", digits: int | None = None, block: int = 2000) -> DataFrame:
    """top_k_batched() for any number of queries (wording, query), a block of them at a time over all vectors."""
    out, held = [], []

    def search() -> None:
        names = F.array(*[F.lit(r["wording"]) for r in held])
        found = top_k_batched(vectors, [r["query"] for r in held], k, id, vector, digits)
        out.append(found.withColumn("wording", F.get(names, F.col("wording"))))
        held.clear()

    for r in queries.orderBy("wording").toLocalIterator():
        held.append(r)
        if len(held) == block:
            search()
    if held:
        search()
    if not out:
        wording = queries.schema["wording"].dataType
        return vectors.limit(0).select(F.lit(None).cast(wording).alias("wording"), id, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    return reduce(DataFrame.unionByName, out)


def top_k_batched(vectors: DataFrame, queries: list[list[float]], k: int, id: str, vector: str = "vector", digits: int | None = None) -> DataFrame:
    """top_k() for many queries over many vectors: one matrix product for each Arrow batch, k rows kept for each query and task.

    With digits, scores are rounded before they are ranked.
    """
    if len(queries) > MOST_QUERIES:
        raise ValueError(f"at most {MOST_QUERIES} queries at once")
    q = np.array(queries, float).reshape(len(queries), -1)
    norm = np.linalg.norm(q, axis=1, keepdims=True)
    q = q / np.where(norm == 0, 1, norm)
    kind = vectors.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for b in batches:
            whole = b.filter(pa.compute.equal(pa.compute.list_value_length(b.column(1)), q.shape[1]))
            if not whole.num_rows:
                continue
            v = whole.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(whole.num_rows, -1)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            s = q @ (v / np.where(n == 0, 1, n)).T
            s = s if digits is None else np.round(s, digits)
            # All that ties with the k-th score stays, so that the id decides in the end.
            least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(q), -np.inf)
            w, i = np.nonzero(s >= least[:, None])
            t = pa.table({"wording": w.astype(np.int32), id: whole.column(0).take(pa.array(i)), "score": s[w, i]})
            kept = t if kept is None else pa.concat_tables([kept, t])
            if kept.num_rows > 200_000:
                kept = best(kept)
        if kept is not None:
            yield from best(kept).to_batches()

    def best(t: pa.Table) -> pa.Table:
        t = t.sort_by([("wording", "ascending"), ("score", "descending"), (id, "ascending")])
        w = t.column("wording").to_numpy()
        start = np.r_[0, np.flatnonzero(w[1:] != w[:-1]) + 1]
        place = np.arange(len(w)) - np.repeat(start, np.diff(np.r_[start, len(w)]))
        return t.filter(pa.array(place < k))

    import pyarrow.compute  # noqa: F401

    found = vectors.select(id, vector).mapInArrow(run, f"wording int, {id} {kind}, score double")
    by = W.partitionBy("wording").orderBy(F.col("score").desc(), F.col(id))
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def collapse(hits: DataFrame, note: str, passage: str, known: Column | None = None) -> DataFrame:
    """(note, passage, score, more): each note's best passage over all wordings, and how many others were found.

    Ties keep the earlier wording, then the earlier rank. Hits that are not known are dropped.
    """
    x = hits if known is None else hits.filter(known)
    by = W.partitionBy(note).orderBy(F.col("score").desc(), "wording", "rank")
    first = x.withColumn("place", F.row_number().over(by))
    more = x.groupBy(note).agg((F.count_distinct(passage) - 1).alias("more"))
    return first.filter("place = 1").select(note, passage, "score").join(more, note)


def adaptive(fetch, note: str, passage: str, count: int) -> DataFrame:
    """collapse() of fetch(k); k is 8 notes' worth, at least 50, and 4 times that, once, if too few notes came of a full list."""
    k = max(8 * count, 50)
    hits = fetch(k)
    full = hits.groupBy("wording").count().filter(F.col("count") >= k).limit(1).count() > 0
    if full and hits.select(note).distinct().limit(count).count() < count:
        hits = fetch(4 * k)
    return collapse(hits, note, passage).orderBy(F.desc("score"), note).limit(count)
