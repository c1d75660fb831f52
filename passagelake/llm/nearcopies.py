"""Near copies by SimHash and by the exact Jaccard similarity of word shingles: the pipeline's stage.

First come op5's links, all of them, found by its operator (simhash.py): texts whose fingerprints
differ in 4 bits or fewer are one group. But 4 of 64 bits reach few edited copies; so texts of a
similarity of SIMILAR or more are linked as well, and a group is what both kinds of links join.

For those a text's set is that of its runs of SHINGLE words (lower case; a shorter text is one run).
Texts with equal sets are one class from the start. Candidates share one of BANDS bands of ROWS minima
of hashes; a pair of similarity 0.8 misses all bands with probability (1 - 0.8^4)^32 = 5e-8. Every
such link is verified by the exact similarity of the two sets:

* first each class with the least class of each of its buckets, so that large groups become one;
* then the buckets that those links and SimHash's haven't joined: in cells of bounded size (cells.py), to which the
  classes bring their sets, so that no pair leaves its task unless it is a link that joins two groups.

Results: as simhash.survivors; wordless texts are one class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagelake.llm import simhash
from passagelake.llm.cells import cells, deal, spanning
from passagelake.llm.common import arrow_map, release, written
from passagelake.llm.components import connected

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 4
SEED = 42
CELL = 4096
#: Hashes of all sets in a block of a bucket.
HASHES = 1 << 21
#: Shingles whose hashes are permuted at once.
CHUNK = 4096

_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted different hashes of a text's shingles."""
    words = (text or b"").lower().split()
    digest = xxhash.xxh64_intdigest
    runs = (b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else ()
    return np.unique(np.fromiter((digest(r, SEED) for r in runs), np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """One hash for each band of minima."""
    least = np.full(BANDS * ROWS, np.uint64((1 << 64) - 1))
    for i in range(0, len(found), CHUNK):
        x = found[i : i + CHUNK, None] * _FACTORS
        np.minimum(least, ((x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)).min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), SEED) for r in least.reshape(BANDS, ROWS)], np.uint64).view(np.int64)


def prints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, bits (SimHash's fingerprint), fp (the set's hash), n (its size) and bands."""

    def run(x: dict[str, pa.Array]) -> dict[str, pa.Array]:
        texts = x["text"].cast(pa.binary()).to_pylist()
        sets = [shingles(t) for t in texts]
        fp = [int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64)) for s in sets]
        return {"bits": pa.array([simhash.fingerprint(t) for t in texts], pa.int64()), "fp": pa.array(fp, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "bands": pa.array([bands(s).tolist() if len(s) else [] for s in sets], pa.list_(pa.int64()))}

    return arrow_map(docs, keep, ["text"], run, [*(T.StructField(c, T.LongType()) for c in ("bits", "fp", "n")), T.StructField("bands", T.ArrayType(T.LongType()))])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of SIMILAR or more."""
    left, right = (sets.select(F.col("fp").alias(f"fp_{c}"), F.col("set").alias(f"set_{c}")) for c in "ab")
    both = pairs.join(left, F.col("a") == F.col("fp_a")).join(right, F.col("b") == F.col("fp_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    # In whole numbers: shared / union >= 4 / 5.
    return both.filter(shared * 100 >= (F.size("set_a") + F.size("set_b") - shared) * int(SIMILAR * 100)).select("a", "b")


def shared_with(ids: np.ndarray, ends: np.ndarray) -> Callable[[int], np.ndarray]:
    """shared(i): how many of row i's numbers each row after it has; row j's are ids[ends[j - 1] : ends[j]], none empty."""
    starts = np.r_[0, ends[:-1]]
    mark = np.zeros(int(ids.max()) + 1, np.int32)

    def shared(i: int) -> np.ndarray:
        own = ids[starts[i] : ends[i]]
        mark[own] = 1
        found = np.add.reduceat(mark[ids[ends[i] :]], starts[i + 1 :] - ends[i])
        mark[own] = 0
        return found

    return shared


def joining(placed: DataFrame, cell: int = CELL, hashes: int = HASHES) -> DataFrame:
    """(a, b): links inside a bucket's classes (band, value, fp, n, component, set) that join its components.

    Pairs are verified where they meet, on the whole sets; only a spanning forest of each cell comes out.
    """
    dealt = deal(placed, ["band", "value"], F.col("fp"), cell, F.col("n"), hashes)
    share = int(SIMILAR * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in cells(batches, 4):
            block, fp, n, component = (group.column(4 + i).to_numpy() for i in range(4))
            across = group.column(2)[0] != group.column(3)[0]
            label = np.unique(component, return_inverse=True)[1]
            if (label == 0).all() or across and (block == block[0]).all():
                continue
            shared = shared_with(np.unique(group.column(8).flatten().to_numpy(), return_inverse=True)[1], np.cumsum(n))

            def neighbours(i: int) -> np.ndarray:
                m = n[i + 1 :]
                fits = (label[i + 1 :] != label[i]) & (100 * np.minimum(m, n[i]) >= share * np.maximum(m, n[i]))
                js = np.flatnonzero(fits & (block[i + 1 :] != block[i]) if across else fits)
                if not len(js):
                    return js
                common = shared(i)[js]
                return i + 1 + js[100 * common >= share * (n[i] + m[js] - common)]

            found = np.array(spanning(len(fp), neighbours, label), np.int64)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(fp[found[:, 0]]), pa.array(fp[found[:, 1]])], names=["a", "b"])
        release()

    return dealt.mapInArrow(run, "a long, b long")


def alike(found: DataFrame) -> DataFrame:
    """(a, b): of the texts (bits, fp) links between classes that join all whose fingerprints SimHash links."""
    rows = written(found.select(F.col("fp").alias("doc_id"), F.col("bits").alias("fp")).distinct(), "fingerprints")
    return written(simhash.grouped(rows).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).filter("a <> b").distinct(), "alike")


def links(docs: DataFrame, classes: DataFrame, first: DataFrame) -> DataFrame:
    """(a, b): links between classes (fp, n, h, bands), the first ones and verified ones, that join all that are linked."""
    rows = classes.select("fp", "n", F.posexplode("bands").alias("band", "value"))
    buckets = rows.groupBy(F.col("band").alias("in_band"), F.col("value").alias("in_value")).agg(F.min("fp").alias("least"), F.count("*").alias("size")).filter("size > 1")
    placed = written(rows.join(buckets, (F.col("band") == F.col("in_band")) & (F.col("value") == F.col("in_value"))).select("band", "value", "fp", "n", "least"), "buckets")
    wanted = classes.join(placed.select("fp").distinct(), "fp", "left_semi").select(F.col("h").alias("text_h"), "fp")
    texts = docs.select(F.xxhash64("text").alias("of_h"), "text").join(wanted, F.col("of_h") == F.col("text_h")).dropDuplicates(["fp"])
    sets = written(arrow_map(texts, ["fp"], ["text"], lambda x: {"set": pa.array([shingles(t).view(np.int64).tolist() for t in x["text"].cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))}, [T.StructField("set", T.ArrayType(T.LongType()))]), "sets")
    stars = written(similar(placed.select(F.col("least").alias("a"), F.col("fp").alias("b")).filter("a <> b").distinct(), sets).unionByName(first), "links")
    joined = connected(stars)
    known = written(placed.join(joined, placed["fp"] == joined["node"], "left").select("band", "value", "fp", "n", F.coalesce("component", "fp").alias("component")), "known")
    # Only buckets that the first links haven't joined are gone through.
    mixed = known.groupBy(F.col("band").alias("in_band"), F.col("value").alias("in_value")).agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    rest = known.join(mixed, (F.col("band") == F.col("in_band")) & (F.col("value") == F.col("in_value"))).select("band", "value", "fp", "n", "component")
    named = sets.select(F.col("fp").alias("of"), "set")
    return stars.unionByName(written(joining(rest.join(named, rest["fp"] == named["of"]).drop("of")), "links"))


def survivors(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: that with the least doc_id (nulls last), then the least hash of its text."""
    named = {"d": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "h": F.xxhash64("text")}
    found = written(prints(docs.select("doc_id", "text").withColumns(named), ["d", "h"]), "sets-of-shingles")
    classes = written(found.groupBy("fp").agg(F.min("n").alias("n"), F.min("h").alias("h"), F.min("bands").alias("bands")), "classes")
    group = connected(links(docs, classes, alike(found)))
    of = found.join(group, found["fp"] == group["node"], "left").select("d", "h", F.coalesce("component", "fp").alias("component"))
    first = of.groupBy("component").agg(F.min(F.struct("d", "h")).alias("first")).select(F.col("first.d").alias("first_d"), F.col("first.h").alias("first_h"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(n) for n, c in named.items()])
    kept = whole.join(first, (F.col("d") == F.col("first_d")) & (F.col("h") == F.col("first_h")))
    return kept.dropDuplicates(["d", "h"]).select("row.*")
