"""Near duplicates by SimHash, found and verified through pivot distance tables.

A pivot distance table holds the Hamming distances of every fingerprint to reference fingerprints.
Two fingerprints that differ in k bits have distances to any reference that differ by at most k,
over all bits as over any segment of them, so that a pair is discarded as soon as one coordinate
differs by more. It is used twice:

* Buckets. The 64 bits are cut into SEGMENTS; of each segment the distances to REFERENCES random
  references are tabled. In a pair with at most MAX_BITS = 4 different bits at least SEGMENTS - 4
  segments are equal, so that all their distances are. Each choice of SEGMENTS - 4 segments is one
  table, and fingerprints with the same distances there meet in its bucket. So no pair is missed,
  and none is formed between fingerprints whose distances already tell them apart.
* Cells. In a bucket, pairs whose distances to the PIVOTS full-length references differ by more
  than MAX_BITS in any coordinate are discarded; the survivors are verified by counting the bits of
  their exclusive or.

A plain scan of the table would compare all pairs; one full-length coordinate lets 57 % of random
pairs pass, which is why the buckets take their addresses from the segments' distances.

Copies share one row from the start; large buckets are compared in blocks (cells.py); of each cell
only a spanning forest is emitted; components are found by stars (components.py).

Results: a null or wordless text has fingerprint zero, and links like any other. Rows with equal
doc_id and different texts are different documents. Null doc_ids take part in links; the component
of documents that all lack an id is null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagelake.llm.cells import cells, deal, spanning
from passagelake.llm.common import arrow_map, release, written
from passagelake.llm.components import connected

SHINGLE = 4
SEED = 42
MAX_BITS = 4
SEGMENTS = 6
REFERENCES = 8
PIVOTS = 16
CELL = 2048
#: Shingles of a text that are hashed at once.
CHUNK = 65536


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Fingerprint as a signed 64-bit integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1][:n].tolist()
    stops = (ends[shingle - 1 :] if len(words) > shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[i : i + CHUNK], stops[i : i + CHUNK], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """keep and fp (long)."""
    return arrow_map(docs, keep, [text], lambda x: {"fp": pa.array([fingerprint(t, shingle) for t in x[text].cast(pa.binary()).to_pylist()], pa.int64())}, [T.StructField("fp", T.LongType())])


def references(n: int, seed: int) -> list[int]:
    return [int(x) for x in np.random.Generator(np.random.PCG64(seed)).integers(-(1 << 63), 1 << 63, n)]


def segments(n: int) -> list[int]:
    """Bit masks of n segments, as signed integers."""
    edges = [64 * i // n for i in range(n + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def distance(fp: Column, reference: int, mask: int = -1) -> Column:
    x = fp.bitwiseXOR(F.lit(reference))
    return F.bit_count(x if mask == -1 else x.bitwiseAND(F.lit(mask))).cast("long")


def packed(numbers: list[Column], bits: int) -> Column:
    out = numbers[0]
    for x in numbers[1:]:
        out = F.shiftleft(out, bits).bitwiseOR(x)
    return out


def tables(fps: DataFrame, n_segments: int = SEGMENTS, max_bits: int = MAX_BITS) -> DataFrame:
    """(table, k0.., fp, p0..): each fingerprint's address in each table, and its distances to the full-length references."""
    fp = F.col("fp")
    per_segment = [packed([distance(fp, r, m) for r in references(REFERENCES, 100 + i)], 4) for i, m in enumerate(segments(n_segments))]
    full = references(PIVOTS, 99)
    pivots = [packed([distance(fp, r) for r in full[i : i + 8]], 8).alias(f"p{i // 8}") for i in range(0, PIVOTS, 8)]
    base = fps.select("fp", *[s.alias(f"s{i}") for i, s in enumerate(per_segment)], *pivots)
    chosen = list(combinations(range(n_segments), n_segments - max_bits))
    addresses = F.array(*[F.struct(F.lit(t).alias("table"), *[F.col(f"s{i}").alias(f"k{j}") for j, i in enumerate(c)]) for t, c in enumerate(chosen)])
    x = base.select("fp", *[f"p{i}" for i in range(PIVOTS // 8)], F.explode(addresses).alias("at"))
    return x.select("at.*", "fp", *[f"p{i}" for i in range(PIVOTS // 8)])


def linked(fp: np.ndarray, pivots: np.ndarray, block: np.ndarray, max_bits: int):
    """neighbours(i) for spanning(): rows after i that the pivots do not discard and that differ in at most max_bits bits."""
    one = block[0] == block[-1] and (block == block[0]).all()
    table = pivots.astype(np.int16)

    def neighbours(i: int) -> np.ndarray:
        js = np.arange(i + 1, len(fp)) if one else i + 1 + np.flatnonzero(block[i + 1 :] != block[i])
        for c in range(0, table.shape[1], 4):
            if len(js):
                js = js[np.abs(table[js, c : c + 4] - table[i, c : c + 4]).max(1) <= max_bits]
        return js[np.bitwise_count(fp[js] ^ fp[i]) <= max_bits] if len(js) else js

    return neighbours


def links(fps: DataFrame, n_segments: int = SEGMENTS, max_bits: int = MAX_BITS, cell: int = CELL) -> DataFrame:
    """(a, b): links between different fingerprints (column fp) that join all that are linked."""
    addressed = tables(fps, n_segments, max_bits)
    bucket = [c for c in addressed.columns if c == "table" or c[0] == "k"]
    dealt = deal(addressed, bucket, F.col("fp"), cell)
    n_key, n_pivots = len(bucket) + 2, PIVOTS // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in cells(batches, n_key):
            block = group.column(n_key).to_numpy()
            fp = group.column(n_key + 1).to_numpy().view(np.uint64)
            pivots = np.hstack([group.column(n_key + 2 + i).to_numpy().view(np.uint8).reshape(-1, 8) for i in range(n_pivots)])
            if group.column(n_key - 2)[0] != group.column(n_key - 1)[0] and (block == block[0]).all():
                continue
            signed = fp.view(np.int64)
            out += [(int(signed[i]), int(signed[j])) for i, j in spanning(len(fp), linked(fp, pivots, block, max_bits))]
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
        release()

    return dealt.mapInArrow(run, "a long, b long")


def grouped(prints: DataFrame, **options) -> DataFrame:
    """prints (doc_id, fp) with component_id, and component, the least fingerprint of the group.

    prints should be a written table, as it is read more than once.
    """
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    found = connected(links(classes.select("fp"), **options))
    label = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    label = written(label, "labels")
    least = label.groupBy(F.col("component").alias("group")).agg(F.min("first_id").alias("component_id"))
    of = label.join(least, label["component"] == least["group"]).select(F.col("fp").alias("class_fp"), "component", "component_id")
    return prints.join(of, prints["fp"] == of["class_fp"]).select(*[prints[c] for c in prints.columns], "component", "component_id")


def survivors(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, with all its columns: that with the least doc_id (nulls last), then the least hash of its text."""
    named = {"d": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "h": F.xxhash64("text")}
    prints = written(fingerprints(docs.select("doc_id", "text").withColumns(named), ["doc_id", "d", "h"]), "fingerprints")
    first = grouped(prints, **options).groupBy("component").agg(F.min(F.struct("d", "h")).alias("first")).select(F.col("first.d").alias("first_d"), F.col("first.h").alias("first_h"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(n) for n, c in named.items()])
    kept = whole.join(first, (F.col("d") == F.col("first_d")) & (F.col("h") == F.col("first_h")))
    return kept.dropDuplicates(["d", "h"]).select("row.*")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    prints = written(fingerprints(docs, ["doc_id"]), "fingerprints")
    return grouped(prints, **options).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
