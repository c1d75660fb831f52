"""Quality rules whose cutoffs adapt to each language and source.

Base rules reject texts of under MIN_WORDS words, or with over MAX_REPEAT percent of their words in
8-word windows that occur twice or more. For the others a few ratios are measured (METRICS), and
each (lang, source) sums up their distribution in a quantile sketch: counts of logarithmic buckets,
which give any quantile with a relative error of ACCURACY, merge by adding, and do not depend on
the order of merging. A cutoff is an outlier fence: the third quartile plus FENCE times the spread
(and the first minus that, for a metric with a lower side), so that a group without outliers keeps all
its documents, however its ratios lie. The spread is the distance of the quartiles, or, if that is
less, the step that one more count makes in a text of the group's median size, as the sketch of the
sizes tells it: most groups have no symbols at all in most texts, and one symbol in a short text is no
outlier. No cutoff or width is a constant. The sketch of a group is blended with that of its language as
if MIN_GROUP documents of the language's distribution belonged to it, and that of a language likewise
with all documents': small groups lean on the larger, and large ones stand for themselves. The cutoffs,
one row for each group, are joined to the documents.

Results: a null or empty text has no words and fails the base rules. A null lang or source is a
value of its own. Equal rows get equal verdicts, and a value on a cutoff is kept. A very long text is
measured whole, in memory that is a few times its size. Columns other than doc_id, text, lang and
source are not looked at, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagelake.llm.common import arrow_map, forget, written

MIN_WORDS = 20
MAX_REPEAT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
ACCURACY = 0.01
FENCE = 8.0
MIN_GROUP = 50
#: Metric: (least step of its count, the size that the count is divided by, whether low values are outliers too).
METRICS = {
    "word_length": (1, "n_words", True),
    "symbol_ratio": (1, "n_words", False),
    "dup_line_ratio": (1, "n_lines", False),
    "repeat_ratio": (2 * WINDOW, "n_words", False),
    "upper_ratio": (1, "n_letters", False),
    "mark_ratio": (1, "n_words", False),
    "same_ratio": (1, "n_words", False),
}
SIZES = ("n_words", "n_lines", "n_letters")
#: Parts of a document in which blended counts are whole numbers.
PARTS = 1024
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more: windows are named by doubling, exactly."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    name = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    if len(names) == len(words):
        return 0
    width = 1
    while width < window:
        step = min(width, window - width)
        pair = name[: len(name) - step] * (int(name.max()) + 1) + name[step:]
        name = np.unique(pair, return_inverse=True)[1] if width + step < window else pair
        width += step
    order = np.argsort(name, kind="stable")
    same = name[order][1:] == name[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:-window] += twice
    edge[window:] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """COUNTS, and lines with a word, upper-case and all ASCII letters, marks, words equal to the word before."""
    text = text or b""
    words = text.split()
    space = text.translate(None, b"\x20\x09\x0a\x0b\x0c\x0d")
    chars = len(space) - len(space.translate(None, CONTINUED)) if not space.isascii() else 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(space) - chars,
        len(space) - len(space.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(space) - len(space.translate(None, UPPER)),
        len(space) - len(space.translate(None, UPPER + LOWER)),
        len(space) - len(space.translate(None, MARKS)),
        sum(map(bytes.__eq__, words[1:], words)) if len(words) > 1 else 0,
    )


CONTINUED = bytes(range(0x80, 0xC0))
UPPER, LOWER, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"!?"


def counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, COUNTS, SIZES and METRICS of every whole text."""

    def run(x: dict[str, pa.Array]) -> dict[str, pa.Array]:
        rows = [measure(t) for t in x[text].cast(pa.binary()).to_pylist()]
        n = np.array(rows, np.int64).reshape(-1, 10)
        words = np.maximum(n[:, 0], 1)
        ratios = {"word_length": n[:, 1] / words, "symbol_ratio": n[:, 2] / words, "dup_line_ratio": n[:, 3] / np.maximum(n[:, 5], 1), "repeat_ratio": n[:, 4] / words, "upper_ratio": n[:, 6] / np.maximum(n[:, 7], 1), "mark_ratio": n[:, 8] / words, "same_ratio": n[:, 9] / words}
        return {c: pa.array(n[:, i]) for i, c in enumerate(COUNTS)} | {"n_lines": pa.array(n[:, 5]), "n_letters": pa.array(n[:, 7])} | {m: pa.array(ratios[m]) for m in METRICS}

    return arrow_map(docs, keep, [text], run, [T.StructField(c, T.LongType()) for c in (*COUNTS, *SIZES[1:])] + [T.StructField(m, T.DoubleType()) for m in METRICS])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def bucket(x: Column, accuracy: float = ACCURACY) -> Column:
    """Sketch bucket of a number that is not negative; its values differ from each other by at most 2 * accuracy."""
    return F.when(x > 0, F.ceil(F.log(x) / math.log((1 + accuracy) / (1 - accuracy))).cast("int"))


def bucket_value(b: Column, accuracy: float = ACCURACY) -> Column:
    growth = (1 + accuracy) / (1 - accuracy)
    return F.coalesce(2 * F.pow(F.lit(growth), b) / (growth + 1), F.lit(0.0))


def sketches(measured: DataFrame, groups: list[str], metrics: list[str], accuracy: float = ACCURACY) -> DataFrame:
    """(groups, metric, bucket, n): one sketch for each group and metric, summed up on both sides of the shuffle."""
    stacked = measured.select(*groups, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m).cast("double"), accuracy).alias("bucket")) for m in metrics])).alias("x"))
    return stacked.groupBy(*groups, "x.metric", "x.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of coarser groups: the counts of equal buckets added."""
    return sketch.groupBy(*groups, "metric", "bucket").agg(F.sum("n").alias("n"))


def blended(sketch: DataFrame, wider: DataFrame, groups: list[str], shared: list[str], min_group: int) -> DataFrame:
    """sketch of the groups, to which min_group documents distributed as in the wider sketch are added; n in PARTS.

    wider has n in PARTS, and a row for each value of the shared columns, metric and bucket.
    """
    total = F.sum("n").over(W.partitionBy(*shared, "metric"))
    share = wider.select(*[F.col(c).alias(f"wide_{c}") for c in shared], F.col("metric").alias("wide_metric"), "bucket", total.alias("total"), "n").select("*", F.expr(f"n * {min_group * PARTS} div total").alias("part")).drop("n", "total")
    on = F.col("metric") == F.col("wide_metric")
    for c in shared:
        on &= F.col(c).eqNullSafe(F.col(f"wide_{c}"))
    lent = sketch.select(*groups, "metric").distinct().join(share, on).select(*groups, "metric", "bucket", F.col("part").alias("n"))
    own = sketch.select(*groups, "metric", "bucket", (F.col("n") * PARTS).alias("n"))
    return merged(own.unionByName(lent), groups)


def quantiles(sketch: DataFrame, groups: list[str], accuracy: float = ACCURACY) -> DataFrame:
    """(groups, metric, q1, q2, q3): the quartiles from the sketches."""
    by = W.partitionBy(*groups, "metric")
    ranked = sketch.withColumns({"upto": F.sum("n").over(by.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("n").over(by)})
    at = lambda i: F.min(F.when(4 * F.col("upto") >= i * F.col("total"), bucket_value(F.col("bucket"), accuracy)))
    return ranked.groupBy(*groups, "metric").agg(*[at(i).alias(f"q{i}") for i in (1, 2, 3)])


def cutoffs(measured: DataFrame, *, metrics: dict[str, tuple[int, str, bool]] = METRICS, fence: float = FENCE, min_group: int = MIN_GROUP, accuracy: float = ACCURACY) -> DataFrame:
    """One row for each (lang, source) with <metric>_low and <metric>_high."""
    sizes = list(dict.fromkeys(size for _, size, _ in metrics.values()))
    fine = written(sketches(measured, ["lang", "source"], [*metrics, *sizes], accuracy), "sketches")
    whole = merged(fine, []).withColumn("n", F.col("n") * PARTS)
    lang = written(blended(merged(fine, ["lang"]), whole, ["lang"], [], min_group), "sketches")
    found = quantiles(blended(fine, lang, ["lang", "source"], ["lang"], min_group), ["lang", "source"], accuracy)
    of = lambda name, q: F.max(F.when(F.col("metric") == name, F.col(q)))
    columns = []
    for m, (step, size, below) in metrics.items():
        reach = fence * F.greatest(of(m, "q3") - of(m, "q1"), step / F.greatest(of(size, "q2"), F.lit(1.0)))
        columns += [(of(m, "q1") - reach if below else F.lit(-1.0)).alias(f"{m}_low"), (of(m, "q3") + reach).alias(f"{m}_high")]
    limits = written(found.groupBy("lang", "source").agg(*columns), "cutoffs")
    forget(fine)
    forget(lang)
    return limits


def judge(measured: DataFrame, limits: DataFrame, metrics: dict[str, tuple[int, str, bool]] = METRICS) -> DataFrame:
    """measured with base_failed, kept and the metrics that are outside their cutoffs."""
    limits = limits.withColumnsRenamed({"lang": "limit_lang", "source": "limit_source"})
    x = measured.join(limits, measured["lang"].eqNullSafe(limits["limit_lang"]) & measured["source"].eqNullSafe(limits["limit_source"]), "left")
    out = F.array(*[F.when((F.col(m) < F.col(f"{m}_low")) | (F.col(m) > F.col(f"{m}_high")), F.lit(m)) for m in metrics])
    x = x.withColumn("outside", F.filter(out, lambda m: m.isNotNull())).withColumn("base_failed", base_failed())
    return x.withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0)).drop("limit_lang", "limit_source", *[f"{m}_{s}" for m in metrics for s in ("low", "high")])


def filtered(docs: DataFrame, **options) -> DataFrame:
    """keys, counts, metrics and verdict of each document; options as of cutoffs()."""
    measured = written(counts(docs, ["doc_id", "lang", "source"]), "measured")
    limits = cutoffs(measured.filter(~base_failed()), **options)
    return judge(measured, limits, options.get("metrics", METRICS))
