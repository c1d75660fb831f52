"""Toxicity by class-conditional Kneser-Ney models of spelled words.

A word is a run of up to 32 letters and digits, lower-cased; a longer run is read as several words,
and in a script without spaces each character begins a word of up to 4 characters. A word is spelled
by its UTF-8 bytes and a byte for its end. Each class, toxic and ordinary, has its own model of which
byte x follows a beginning h, learnt from the number of labelled texts of the class that hold a word
with that beginning (each different word once a text, so that one text's repetitions count once).
Rare beginnings are smoothed by counts that both classes share, which back off in turn:

    P_c(x | h) = (max(n_c(hx) - D, 0) + (D * types_c(h) + prior_c) * P(x | h)) / (n_c(h) + prior_c)
    P(x | h)   = (max(n(hx) - D, 0) + D * types(h) * P(x | y)) / n(h)               y: last byte of h
    P(x | y)   = (max(m(yx) - D, 0) + D * types(y) * P(x)) / m(y)    m: different beginnings that end so
    P(x)       = the same for the number of bytes y that come before x, over an even distribution

prior_c is PRIOR texts of the smaller class, and the same share of the other. The log-likelihood of a
word is the sum over its bytes; where a beginning was never seen, both classes go on alike, after one
step to what each leaves for unseen bytes. So a stem is learnt even if each of its inflected words is
rare. Expressions of several words are scored by their words.

A text's evidence is the mean over all its words (LEAST_WORDS at least) of the toxic minus the ordinary
log-likelihood, where a word counts by what it has over MARGIN nats: toxic texts too consist of ordinary
words mostly, on which the classes differ by topic, language and chance. Evidence becomes a score by
isotonic regression over labelled texts that the counts have not seen.

The counts are a table of all beginnings that grows with the labelled texts. The different words of
the texts are merged with it in sorted streams, one for all that begins with the same GROUP bytes, in
which a word's deepest known beginning is the last one before it; the memory that this takes is that
of one word's beginnings. What several streams share, the beginnings of up to two bytes, is broadcast
(at most 2^16 rows), and the longer ones are joined to each stream.

Results: null and empty texts, texts without letters, have evidence 0. Equal texts get equal scores,
and count once in learning, toxic if any is; ties and repeated rows change nothing. A very long text
is read to its end in slices. Repeated label rows of a document count once, toxic if any is; null
labels are none. Without labelled texts of both classes every score is 0. An empty table gives an
empty result. Columns other than the named ones are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagelake.llm.common import BitMap, arrow_column, arrow_map, forget, release, written

DISCOUNT = 0.75
PRIOR = 3.0
MARGIN = 2.0
#: Score from which a document is called toxic.
TOXIC = 0.7
#: Texts with fewer words count as if they had so many.
LEAST_WORDS = 10
#: Of the labelled texts to learn from, one in so many sets the scores instead of the counts.
CALIBRATE = 5
#: Bins of the square root of the evidence, up to LIMIT.
BINS, LIMIT = 1000, 2.5
#: Parts of a nat in which evidence is a whole number, so that sums don't depend on their order.
UNIT = 1 << 32
#: Different words that a task holds before it passes them on, and characters of a text whose words are listed at once.
HELD = 300_000
SLICE = 1 << 20

WORD = re.compile(r"[^\W_]{1,32}")
#: Letters of scripts that are written without spaces.
UNSPACED = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0x20000, 0x3FFFF))) + "]")
PIECE = 4
#: Bytes that the words of one sorted stream begin with: more make finer streams.
GROUP = 4
END = b"\0"


def words(text: str) -> Iterator[list[str]]:
    """All words of a text, in lists of bounded size."""
    text = text.lower()
    if len(text) <= SLICE:
        lists: Iterator[list[str]] = iter([WORD.findall(text)])
    else:
        found = WORD.finditer(text)
        lists = iter(lambda: [m[0] for m in islice(found, SLICE // 8)], [])
    unspaced = not text.isascii() and UNSPACED.search(text)
    for part in lists:
        yield [p for w in part for p in (pieces(w) if UNSPACED.search(w) else (w,))] if unspaced else part


def pieces(word: str) -> list[str]:
    return [word[i : i + PIECE] for i in range(len(word))]


def word_id(spelled: bytes) -> int:
    """Signed 64-bit hash of a word with its end."""
    h = xxhash.xxh64_intdigest(spelled, 42)
    return h - (1 << 64) if h >> 63 else h


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def group_of(spelled: str = "spelled"):
    """The first GROUP bytes: what begins so is read as one sorted stream."""
    return F.substring(spelled, 1, GROUP)


def streams(rows: DataFrame, *order: str) -> DataFrame:
    """rows (group, spelled, ...) in sorted streams, none of them split between tasks."""
    return rows.repartition("group").sortWithinPartitions("spelled", *order).drop("group")


def shorter(beginnings: DataFrame, size: int) -> DataFrame:
    """The beginnings of size bytes that those of one byte more extend."""
    held = lambda c: F.count_if(F.col(c) > 0)
    return beginnings.groupBy(F.substring("spelled", 1, size).alias("spelled")).agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"), held("ordinary").alias("kinds_ordinary"), held("toxic").alias("kinds_toxic"), F.count("*").alias("kinds"))


def count(texts: DataFrame) -> DataFrame:
    """texts (text, toxic 0 or 1) to all beginnings of two bytes or more, with the texts of each class and the kinds of the next byte."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        counts: dict[str, int] = {}
        for text, toxic in rows_of(batches):
            one = 1 << 32 if toxic else 1
            for w in {w for part in words(text or "") for w in part}:
                counts[w] = counts.get(w, 0) + one
            if len(counts) > HELD:
                yield from ((w.encode() + END, n & 0xFFFFFFFF, n >> 32) for w, n in counts.items())
                counts = {}
        yield from ((w.encode() + END, n & 0xFFFFFFFF, n >> 32) for w, n in counts.items())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(held(batches), pa.schema([("spelled", pa.binary()), ("ordinary", pa.int64()), ("toxic", pa.int64())]))
        release()

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        word, open_ = b"", []  # of each beginning of the word from GROUP bytes on, and of a shorter word: ordinary, toxic, kinds of each class, kinds
        for next_, ordinary, toxic in rows_of(batches):
            if next_ != word:
                shared = common(word, next_)
                yield from closed(word, open_, shared)
                open_ += [[0, 0, 0, 0, 0] for _ in range(len(next_) - max(shared, least(next_)))]
                word = next_
            open_[-1][0] += ordinary
            open_[-1][1] += toxic
        yield from closed(word, open_, 0)

    schema = pa.schema([("spelled", pa.binary())] + [(c, pa.int64()) for c in STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(grown(batches), schema)
        release()

    found = texts.select("text", F.col("toxic").cast("int")).mapInArrow(counted, "spelled binary, ordinary long, toxic long")
    counted_ = streams(found.withColumn("group", group_of())).mapInArrow(run, "spelled binary, " + ", ".join(f"{c} long" for c in STATS))
    longer = written(counted_, "beginnings")
    size = F.octet_length("spelled")
    whole = longer
    for n in range(GROUP - 1, 1, -1):
        whole = whole.unionByName(shorter(whole.filter(size == n + 1), n))
    out = written(whole, "beginnings")
    forget(longer)
    return out


STATS = ("ordinary", "toxic", "kinds_ordinary", "kinds_toxic", "kinds")


def common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = 0
    for x, y in zip(a, b):  # noqa: B905
        if x != y:
            break
        n += 1
    return n


def least(word: bytes) -> int:
    """Bytes of the longest beginning that several streams may share."""
    return min(GROUP, len(word)) - 1


def closed(word: bytes, open_: list[list[int]], keep: int) -> Iterator[tuple]:
    """Closes the beginnings of a word that are longer than keep, and adds them to those that they extend."""
    for size in range(len(word), max(keep, least(word)), -1):
        s = open_.pop()
        if open_:
            add(open_[-1], s)
        yield (word[:size], *s)


def add(to: list[int], s: list[int]) -> None:
    to[0] += s[0]
    to[1] += s[1]
    to[2] += s[0] > 0
    to[3] += s[1] > 0
    to[4] += 1


class Spelling:
    """What all words share: the beginnings of up to two bytes with their differences, and P(x | y). At most 2^16 rows each."""

    def __init__(self, shortest: list[tuple], pairs: np.ndarray, texts: tuple[int, int]):
        least = min(texts)
        self.prior = tuple(PRIOR * n / least for n in texts)
        root, first = [0] * 5, {}
        for spelled, *s in shortest:
            add(first.setdefault(spelled[:1], [0] * 5), s)
        for spelled, s in first.items():
            add(root, s)
            pairs[0, spelled[0]] = 1
        kinds = pairs > 0
        before = kinds.sum(0)
        even = (np.maximum(before - DISCOUNT, 0) + DISCOUNT * (before > 0).sum() / 256) / max(1, before.sum())
        self.after = ((np.maximum(pairs - DISCOUNT, 0) + DISCOUNT * kinds.sum(1)[:, None] * even) / np.maximum(pairs.sum(1), 1)[:, None]).tolist()
        self.top = {b"": (0.0, *root)}
        for spelled, *s in sorted([(k, *v) for k, v in first.items()] + shortest, key=lambda x: (len(x[0]), x[0])):
            self.top[spelled] = (self.longer(self.top[spelled[:-1]], spelled, s[0], s[1]), *s)

    def longer(self, parent: tuple, spelled: bytes, ordinary: int, toxic: int) -> float:
        """Difference of the log-likelihoods of a beginning, from that of one byte less."""
        differ, o, t, ko, kt, k = parent
        last = spelled[-2] if len(spelled) > 1 else 0
        shared = (max(ordinary + toxic - DISCOUNT, 0) + DISCOUNT * k * self.after[last][spelled[-1]]) / (o + t)
        of_o, of_t = self.prior
        p_t = (max(toxic - DISCOUNT, 0) + (DISCOUNT * kt + of_t) * shared) / (t + of_t)
        p_o = (max(ordinary - DISCOUNT, 0) + (DISCOUNT * ko + of_o) * shared) / (o + of_o)
        return differ + math.log(p_t / p_o)

    def unseen(self, parent: tuple) -> float:
        """Difference of a word that goes on from a beginning as no word did."""
        differ, o, t, ko, kt, _ = parent
        of_o, of_t = self.prior
        return differ + math.log((DISCOUNT * kt + of_t) / (t + of_t)) - math.log((DISCOUNT * ko + of_o) / (o + of_o))


class Model:
    """Table of beginnings with their counts, what words share, and the scores of the evidence."""

    def __init__(self, beginnings: DataFrame, spelling: Spelling):
        self.beginnings, self.spelling = beginnings, spelling
        self.edges, self.values = np.array([0.0, 1.0]), np.array([0.0, 0.0])

    @property
    def scale(self) -> tuple[np.ndarray, np.ndarray]:
        return self.edges, self.values

    def calibrate(self, bins: np.ndarray, toxic: np.ndarray, total: np.ndarray) -> None:
        """Pool adjacent violators over the bins; a weak prior of the mean rate joins each block."""
        mean = toxic.sum() / total.sum()
        blocks: list[list[float]] = []
        for b, t, n in sorted(zip(bins.tolist(), toxic.tolist(), total.tolist(), strict=True)):
            blocks.append([t, n, b, b])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                t2, n2, _, last = blocks.pop()
                blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + n2, blocks[-1][2], last]
        xs, ys = [], []
        for t, n, first, last in blocks:
            for b in dict.fromkeys((first, last)):
                xs.append(b * LIMIT / BINS)
                ys.append((t + 0.5 * mean) / (n + 0.5))
        self.edges, self.values = np.array(xs), np.maximum.accumulate(np.array(ys))


def distinct_words(texts: DataFrame) -> DataFrame:
    """The different words of texts (text), spelled; a word may come from several tasks."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: set[str] = set()
        for (text,) in rows_of(batches):
            for part in words(text or ""):
                held.update(part)
                if len(held) > HELD:
                    yield from ((w.encode() + END,) for w in held)
                    held = set()
        yield from ((w.encode() + END,) for w in held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(found(batches), pa.schema([("spelled", pa.binary())]))
        release()

    return texts.select("text").mapInArrow(run, "spelled binary")


def telling_words(texts: DataFrame, model: Model) -> DataFrame:
    """(word, over): the words of texts that have evidence, by word_id, and how much in UNITs."""
    spelling = texts.sparkSession.sparkContext.broadcast(model.spelling)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known, path, word = spelling.value, [], None  # path: (beginning, its statistics) of all beginnings of the present row
        for spelled, is_word, *s in rows_of(batches):
            while path and not spelled.startswith(path[-1][0]):
                path.pop()
            if not is_word:
                if path and path[-1][0] == spelled:  # several groups of this task begin so
                    continue
                parent = path[-1][1] if path else known.top[spelled[:-1]]
                path.append((spelled, (known.longer(parent, spelled, s[0], s[1]), *s)))
            elif spelled != word:
                word = spelled
                deepest, stats = path[-1] if path else next((b, known.top[b]) for b in (spelled[:2], spelled[:1], b"") if b in known.top)
                over = (stats[0] if deepest == spelled else known.unseen(stats)) - MARGIN
                if over > 0:
                    yield word_id(spelled), round(over * UNIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(looked_up(batches), pa.schema([("word", pa.int64()), ("over", pa.int64())]))
        release()

    nothing = [F.lit(0).cast("long").alias(c) for c in STATS]
    size = F.octet_length("spelled")
    found = written(distinct_words(texts), "words")
    seen = model.beginnings.filter(size >= GROUP - 1)  # the shorter ones are in known.top
    both = seen.select("spelled", F.lit(False).alias("is_word"), *STATS).unionByName(found.select("spelled", F.lit(True).alias("is_word"), *nothing)).withColumn("group", group_of())
    # Each group also gets the beginning of one byte less, which other groups share.
    groups = both.filter(size >= GROUP).select(F.col("group").alias("of")).distinct()
    above = groups.join(seen.filter(size == GROUP - 1).hint("merge"), F.substring("of", 1, GROUP - 1) == F.col("spelled"))
    shared = above.select("spelled", F.lit(False).alias("is_word"), *STATS, F.col("of").alias("group"))
    out = written(streams(both.unionByName(shared), "is_word").mapInArrow(run, "word long, over long"), "telling")
    forget(found)
    return out


def text_id():
    return F.xxhash64("text")


def evidence(texts: DataFrame, model: Model) -> DataFrame:
    """(id, evidence): of each different text that has any, by text_id.

    Each different word is looked up once; then the telling words are joined to the texts that hold them.
    """
    telling = telling_words(texts, model)
    told = BitMap.of(telling, "word")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known: dict[str, int | None] = {}
        for id_, text in rows_of(batches):
            n, counts = 0, Counter()
            for part in words(text or ""):
                counts.update(part)
                n += len(part)
            if len(known) > HELD:
                known = {}
            for w, times in counts.items():
                hit = known.get(w, 0)
                if hit == 0:
                    h = word_id(w.encode() + END)
                    hit = known[w] = h if h in told else None
                if hit is not None:
                    yield id_, n, hit, times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(places(batches), pa.schema([("id", pa.int64()), ("n", pa.int64()), ("hit", pa.int64()), ("times", pa.int64())]))
        release()

    hits = texts.select(text_id().alias("id"), "text").mapInArrow(run, "id long, n long, hit long, times long")
    # Equal texts have equal ids, so each word of theirs is taken once. A word's evidence is the same wherever it comes from.
    once = hits.join(telling.hint("merge"), F.col("hit") == F.col("word")).groupBy("id", "n", "hit").agg(F.max(F.col("over") * F.col("times")).alias("over"))
    return once.groupBy("id", "n").agg(F.sum("over").alias("over")).select("id", (F.col("over") / F.lit(float(UNIT)) / F.greatest("n", F.lit(LEAST_WORDS))).alias("evidence"))


def numbers(evidence: pa.Array) -> np.ndarray:
    """Null, of a text without telling words, is 0."""
    return evidence.fill_null(0.0).to_numpy(zero_copy_only=False)


def score_of(evidence: np.ndarray, edges: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Isotonic, with a slope of a hundredth so that evidence still orders equal values."""
    x = np.minimum(np.sqrt(evidence), LIMIT)
    return 0.99 * np.interp(x, edges, values) + 0.01 * x / LIMIT


def bin_of(evidence: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.sqrt(evidence) * BINS / LIMIT), BINS).astype(np.int32)


def train(labelled: DataFrame) -> Model | None:
    """The model of labelled (doc_id, text, toxic); None unless both classes occur.

    All is counted and compared on the executors; the driver gets the shortest beginnings, pairs of bytes and BINS bins.
    """
    part = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("doc_id")), F.lit(CALIBRATE))
    counted = labelled.filter(part != 0)
    toxic, total = counted.agg(F.sum(F.col("toxic").cast("long")), F.count("*")).first()
    if not toxic or toxic == total:
        return None
    beginnings = count(counted)
    shortest = [tuple(r) for r in beginnings.filter(F.octet_length("spelled") == 2).collect()]
    if not shortest:
        return None
    pairs = np.zeros((256, 256))
    for r in beginnings.groupBy(F.substring("spelled", -2, 2).alias("last")).count().collect():
        pairs[r["last"][0], r["last"][1]] = r["count"]
    model = Model(beginnings, Spelling(shortest, pairs, (total - toxic, toxic)))
    apart = written(labelled.filter(part == 0).select(text_id().alias("text_id"), "text", "toxic"), "calibration")
    found = evidence(apart, model)
    each = apart.select("text_id", "toxic").join(found.hint("merge"), F.col("text_id") == F.col("id"), "left")
    bins = arrow_map(each, ["toxic"], ["evidence"], lambda x: {"bin": pa.array(bin_of(numbers(x["evidence"])))}, [T.StructField("bin", T.IntegerType())])
    rows = bins.groupBy("bin").agg(F.sum(F.col("toxic").cast("long")).alias("toxic"), F.count("*").alias("n")).collect()
    if rows:
        model.calibrate(*(np.array([r[i] for r in rows], float) for i in range(3)))
    forget(apart)
    return model


def fold_of(folds: int):
    """crc32 of doc_id as text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def held_out_flag(folds: int = 3, fold: int = 1):
    return F.coalesce(fold_of(folds) == fold, F.lit(False))


def label_rows(docs: DataFrame, labels: DataFrame, folds: int, held_out: int) -> DataFrame:
    """doc_id, text, toxic of the labelled documents outside the held-out fold; of equal texts, that with the least id."""
    open_ = F.col("doc_id").isNotNull() & (fold_of(folds) != held_out)
    known = labels.filter(F.col("toxic").isNotNull() & open_).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select("doc_id", "text").filter(open_)
    # Merge joins at any size: a broadcast of the labels would grow with them. Ids of texts are joined first, the texts last.
    ids = texts.select("doc_id", text_id().alias("id")).join(known.hint("merge"), F.col("doc_id") == F.col("label_id"))
    first = ids.groupBy("id").agg(F.min("doc_id").alias("first_id"), F.max("toxic").alias("toxic"))
    return texts.join(first.hint("merge"), (F.col("doc_id") == F.col("first_id")) & (text_id() == F.col("id"))).select("doc_id", "text", "toxic")


def fitted(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> Model | None:
    """Model trained on the labelled documents outside the held-out fold; they are written once, as two passes read them."""
    rows = written(label_rows(docs, labels, folds, held_out), "labelled")
    model = train(rows)
    forget(rows)
    return model


def score(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """keep and score (0 to 1)."""
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    found = written(evidence(docs.select("text"), model), "evidence")
    each = docs.select(F.struct(*keep).alias("row"), text_id().alias("text_id")).join(found.hint("merge"), F.col("text_id") == F.col("id"), "left")
    scale = model.scale
    scored = arrow_column(lambda e: pa.array(score_of(numbers(e), *scale)), "double")
    return each.select("row.*", scored("evidence").alias("score"))


def kept(docs: DataFrame, model: Model | None, limit: float) -> DataFrame:
    """The documents whose score is below limit, with all their columns.

    Only documents that share a bit of a map of fixed size with a rejected text are shuffled.
    """
    if model is None:
        return docs
    scale = model.scale
    scored = arrow_column(lambda e: pa.array(score_of(numbers(e), *scale)), "double")
    rejected = written(evidence(docs.select("text"), model).filter(scored("evidence") >= limit).select("id"), "rejected")
    each = docs.select(F.struct(*docs.columns).alias("row"), text_id().alias("text_id"), BitMap.of(rejected, "id").holds(text_id()).alias("marked"))
    clean = each.filter(~F.col("marked")).select("row.*")
    return clean.unionAll(each.filter("marked").join(rejected.hint("merge"), F.col("text_id") == F.col("id"), "left_anti").select("row.*"))
