"""Repeated line runs, found by a suffix array over line-ID sequences, and deletion of later copies.

A document is the sequence of its lines that hold a word (\\n-split, stripped); equal lines have
equal IDs. Suffixes are ranked by distributed prefix doubling: rank k of a position orders the
2**k lines from there, and rank k + 1 comes from the pair of ranks k at the position and 2**k lines
later. A position whose 2**k lines occur nowhere else is discarded, so that only repeated text is
ever sorted. Suffixes that share their first n lines form a longest-common-prefix interval; it is
named by n and the ranks (of the largest 2**k up to n) at its first line and n - 2**k lines later.

A run is repeated text if it has MIN_WORDS words or more. Of every position the least run of so
many words that begins there, and the least that ends there, is looked up; every maximal repeated
run is the union of such least runs. In each interval the first occurrence, by doc_id and line,
stays; a line is deleted if it lies in a later one. So every deleted line is still there earlier.

Documents with equal line sequences share one row from the start: of those the first is compared,
and the others are deleted whole if they have MIN_WORDS words.

Results: null and wordless texts have no lines and stay as they are. A blank line goes with the
line before it. Null doc_ids sort last. Rows with equal doc_id and text are the same document and
get the same result. Equal IDs are equal 64-bit hashes. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagelake.llm.common import arrow_map, forget, written
from passagelake.llm.ranking import dense_rank

MIN_WORDS = 50
LAST = (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """docs with d and h, which name a document: its id (last if null) and a hash of its text."""
    return docs.withColumns({"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "h": F.xxhash64("text")})


def least_runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the least run of `least` words from each line on, and up to each line; 0 if there is none."""
    total = np.r_[0, np.cumsum(words)]
    at = np.arange(len(words))
    end = np.searchsorted(total, total[:-1] + least)
    forward = np.where(end <= len(words), end - at, 0)
    begin = np.searchsorted(total, total[1:] - least, side="right") - 1
    return forward, np.where(begin >= 0, at + 1 - begin, 0)


def sequences(docs: DataFrame, min_words: int) -> DataFrame:
    """(d, h, whole, n_words, lines, forward, backward): one row for each document; whole names the line sequence."""

    def run(x: dict[str, pa.Array]) -> dict[str, pa.Array]:
        out: dict[str, list] = {k: [] for k in ("whole", "n_words", "lines", "forward", "backward")}
        digest = xxhash.xxh64_intdigest
        for t in x["text"].cast(pa.binary()).to_pylist():
            kept = [(s, len(s.split())) for s in map(bytes.strip, (t or b"").split(b"\n")) if s]
            ids = np.array([digest(s) for s, _ in kept], np.uint64).view(np.int64)
            words = np.array([n for _, n in kept], np.int64)
            forward, backward = least_runs(words, min_words)
            out["whole"].append(xxhash.xxh64_intdigest(ids.tobytes(), 1) - (1 << 63))
            out["n_words"].append(int(words.sum()))
            out["lines"].append(ids)
            out["forward"].append(forward.astype(np.int32))
            out["backward"].append(backward.astype(np.int32))
        kinds = {"whole": pa.int64(), "n_words": pa.int64(), "lines": pa.list_(pa.int64()), "forward": pa.list_(pa.int32()), "backward": pa.list_(pa.int32())}
        return {k: pa.array(v, kinds[k]) for k, v in out.items()}

    ints = T.ArrayType(T.IntegerType())
    fields = [T.StructField("whole", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("lines", T.ArrayType(T.LongType())), T.StructField("forward", ints), T.StructField("backward", ints)]
    return arrow_map(keyed(docs), ["d", "h"], ["text"], run, fields)


def positions(firsts: DataFrame) -> DataFrame:
    """(d, h, pos, r, forward, backward) of all lines that occur twice or more; r is rank 0."""
    lines = firsts.select("d", "h", F.posexplode(F.arrays_zip("lines", "forward", "backward")).alias("pos", "x")).select("d", "h", "pos", F.col("x.lines").alias("line"), F.col("x.forward").alias("forward"), F.col("x.backward").alias("backward"))
    twice = lines.groupBy(F.col("line").alias("same")).agg(F.count("*").alias("n")).filter("n > 1")
    ranks = dense_rank(twice, ["same"], "lines", distinct=True)
    out = written(lines.join(ranks, F.col("line") == F.col("same")).select("d", "h", "pos", F.col("rank").alias("r"), "forward", "backward"), "rank")
    forget(ranks)
    return out


def doubled(rows: DataFrame, width: int) -> DataFrame:
    """(d, h, pos, r): ranks of twice the width, of what occurs twice or more."""
    later = rows.select(F.col("d").alias("d2"), F.col("h").alias("h2"), (F.col("pos") - width).alias("pos2"), F.col("r").alias("r2"))
    pairs = rows.select("d", "h", "pos", "r").join(later, (F.col("d") == F.col("d2")) & (F.col("h") == F.col("h2")) & (F.col("pos") == F.col("pos2"))).select("d", "h", "pos", "r", "r2")
    pairs = written(pairs, "pairs")
    twice = pairs.groupBy(F.col("r").alias("ra"), F.col("r2").alias("rb")).agg(F.count("*").alias("n")).filter("n > 1")
    ranks = dense_rank(twice, ["ra", "rb"], "ranks", distinct=True)
    out = written(pairs.join(ranks, (F.col("r") == F.col("ra")) & (F.col("r2") == F.col("rb"))).select("d", "h", "pos", F.col("rank").alias("r")), "rank")
    forget(pairs)
    forget(ranks)
    return out


def intervals(ranks: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """(d, h, start, n, ra, rb): of the windows of width to 2 * width - 1 lines those that occur twice, with their interval's name."""
    mine = windows.filter((F.col("n") >= width) & (F.col("n") < 2 * width))
    for side, at in (("a", F.col("start")), ("b", F.col("start") + F.col("n") - width)):
        there = ranks.select(F.col("d").alias("d2"), F.col("h").alias("h2"), F.col("pos").alias("pos2"), F.col("r").alias(f"r{side}"))
        mine = mine.join(there, (F.col("d") == F.col("d2")) & (F.col("h") == F.col("h2")) & (at == F.col("pos2"))).drop("d2", "h2", "pos2")
    return mine


def later_runs(firsts: DataFrame) -> DataFrame:
    """(d, h, start, n): least runs of which an equal one is earlier."""
    ranks = positions(firsts)
    forward = ranks.filter("forward > 0").select("d", "h", F.col("pos").alias("start"), F.col("forward").alias("n"))
    backward = ranks.filter("backward > 0").select("d", "h", (F.col("pos") - F.col("backward") + 1).alias("start"), F.col("backward").alias("n"))
    windows = written(forward.unionByName(backward).distinct(), "windows")
    longest = windows.agg(F.max("n")).first()[0] or 0
    first_ranks, width, found = ranks, 1, []
    while width <= longest:
        found.append(written(intervals(ranks, windows, width), "intervals"))
        if 2 * width <= longest:
            then, ranks = ranks, doubled(ranks, width)
            forget(then)
        width *= 2
    forget(ranks if ranks is not first_ranks else first_ranks)
    forget(windows)
    if not found:
        return ranks.select("d", "h", F.col("pos").alias("start"), F.col("forward").alias("n")).limit(0)
    named = found[0]
    for x in found[1:]:
        named = named.unionByName(x)
    place = F.struct("d", "h", "start")
    first = written(named.groupBy(F.col("n").alias("n1"), F.col("ra").alias("ra1"), F.col("rb").alias("rb1")).agg(F.min(place).alias("first"), F.count("*").alias("copies")).filter("copies > 1"), "first")
    joined = named.join(first, (F.col("n") == F.col("n1")) & (F.col("ra") == F.col("ra1")) & (F.col("rb") == F.col("rb1")))
    return joined.filter(place > F.col("first")).select("d", "h", "start", "n")


def decisions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, h, spans) of the documents that lose lines: [start, end) in the sequence of lines with a word; a null end is the last."""
    seen = written(sequences(docs, min_words), "sequences")
    enough = seen.filter(F.col("n_words") >= min_words)
    # Written, so that the join gets shuffles of its own, in which a sequence with very many copies can be split.
    same = written(enough.groupBy(F.col("whole").alias("same_whole")).agg(F.min(F.struct("d", "h")).alias("first")), "same")
    enough = enough.join(same, F.col("whole") == F.col("same_whole"))
    place = F.struct("d", "h")
    firsts = enough.filter(place == F.col("first")).dropDuplicates(["d", "h"])
    copies = enough.filter(place > F.col("first")).select("d", "h").distinct()
    spans = later_runs(written(firsts.select("d", "h", "lines", "forward", "backward"), "firsts"))
    spans = spans.groupBy("d", "h").agg(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), (F.col("start") + F.col("n")).cast("int").alias("end"))).alias("spans"))
    whole = copies.select("d", "h", F.array(F.struct(F.lit(0).alias("start"), F.lit(None).cast("int").alias("end"))).alias("spans"))
    return written(spans.unionByName(whole), "spans")


def cut(text: str, spans: list[tuple[int, int | None]] | None) -> tuple[str, int, int, int, list[tuple[int, int]]]:
    """The text without the lines of the spans; its lines with a word, deleted ones, deleted words, and the \\n-split lines deleted as [start, end)."""
    lines = text.split("\n")
    encoded = [x.encode().split() for x in lines]
    n = sum(map(bool, encoded))
    if not spans:
        return text, n, 0, 0, []
    edge = np.zeros(n + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[n if b is None else b] -= 1
    gone = np.cumsum(edge)[:n] > 0
    i, last, keep, words, deleted = -1, False, [], 0, []
    for number, (line, w) in enumerate(zip(lines, encoded, strict=True)):
        if w:
            i += 1
            last = bool(gone[i])
            words += len(w) * last
        if not last:
            keep.append(line)
        elif deleted and deleted[-1][1] == number:
            deleted[-1] = (deleted[-1][0], number + 1)
        else:
            deleted.append((number, number + 1))
    return "\n".join(keep), n, int(gone.sum()), words, deleted


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_deleted", T.LongType()), T.StructField("deleted_words", T.LongType()), T.StructField("deleted_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text that is left, and n_lines, n_deleted, deleted_words, deleted_spans (columns of these names are replaced)."""
    extra = [f.name for f in RESULT][1:]
    kept = [c for c in docs.columns if c not in ("text", *extra)]
    spans = decisions(docs, min_words).withColumnsRenamed({"d": "span_d", "h": "span_h"})
    inner = keyed(docs.select("doc_id", "text", F.struct(*kept).alias("rest")))
    # A merge join at any size: how many documents lose lines grows with the documents.
    x = inner.join(spans.hint("merge"), (F.col("d") == F.col("span_d")) & (F.col("h") == F.col("span_h")), "left").select("rest", "text", "spans")

    def run(c: dict[str, pa.Array]) -> dict[str, pa.Array]:
        rows = [(t, 0, 0, 0, []) if t is None else cut(t, s and [(y["start"], y["end"]) for y in s]) for t, s in zip(c["text"].to_pylist(), c["spans"].to_pylist(), strict=True)]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        out = {f"new_{f.name}": pa.array([r[i] for r in rows], k) for i, (f, k) in enumerate(zip(RESULT, kinds, strict=False))}
        out["new_deleted_spans"] = pa.array([[{"start": a, "end": b} for a, b in r[4]] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        return out

    done = arrow_map(x, ["rest"], ["text", "spans"], run, [T.StructField(f"new_{f.name}", f.dataType) for f in RESULT])
    named = {c: F.col("rest").getField(c).alias(c) for c in kept}
    order = [F.col("new_text").alias("text") if c == "text" else named[c] for c in docs.columns if c not in extra]
    return done.select(*order, *[F.col(f"new_{c}").alias(c) for c in extra])
