"""Language identification with hyperdimensional profiles.

Every letter has a random vector of DIMENSIONS signs, made from its code point and a seed. An
n-gram of three letters is bound into one vector: the first letter's vector rotated by two places,
times the second's rotated by one, times the third's. A text is the bundle (sum) of its n-grams'
vectors, a language the bundle of its documents' n-grams; the language whose bundle has the highest
cosine with the text's, after the bundle of all languages is taken out of both, is predicted.

Letters are of the Unicode categories L*, in lower case; runs of other characters count as one
boundary, which has a vector of its own. Bundles are sums of integers, so that the order in which
executors add them does not matter.

Results: a null text, or one without letters, is `und` with score 0; so is every text if no
labelled document has a letter. Equal texts get equal predictions; of equal cosines the language
that sorts first wins. The score is the cosine, at least 0. An empty table gives an empty result.
A very long text is read to its end in pieces. Columns other than doc_id, text and lang are not looked
at, whatever their names. Memory: a vector of DIMENSIONS numbers for each different value of lang.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagelake.llm.common import arrow_map
from passagelake.llm.toxicity import fold_of

DIMENSIONS = 1024
SEED = 71
UNKNOWN = "und"
#: Code points taken at once, and different n-grams for which the dense table of all triples is used.
SCAN = 2_000_000
DENSE = 1 << 22

NO_LETTER = re.compile(r"\W")

_LETTER = np.full(0x110000, -1, np.int32)
_VECTORS: dict[int, np.ndarray] = {}


def letters(points: np.ndarray) -> np.ndarray:
    """Lower-case letter (a code point) of each code point, 0 if it is no letter."""
    there = np.flatnonzero(np.bincount(points, minlength=1)) if len(points) else points
    for p in there[_LETTER[there] < 0]:
        c = chr(p)
        low = c.lower()
        _LETTER[p] = (ord(low) if len(low) == 1 else p) if unicodedata.category(c)[0] == "L" else 0
    return _LETTER[points]


def vector(letter: int) -> np.ndarray:
    if letter not in _VECTORS:
        bits = np.random.Generator(np.random.PCG64([SEED, int(letter)])).integers(0, 2, DIMENSIONS, np.int8)
        _VECTORS[letter] = (2 * bits - 1).astype(np.int8)
    return _VECTORS[letter]


def parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SCAN characters; a longer text is a run of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > first and size + n > SCAN:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def pieces(text: str) -> Iterator[str]:
    """A text of over SCAN characters in pieces that end after a character that is no letter, so that n-grams stay whole."""
    at = 0
    while at < len(text):
        found = NO_LETTER.search(text, at + SCAN)
        end = len(text) if found is None else found.end()
        yield text[at:end]
        at = end


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram) of each n-gram, the different n-grams as triples of letters, and each text's number of letters."""
    joined = "\0".join(t or "" for t in texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    lengths = np.array([len(t or "") + 1 for t in texts])
    text = np.repeat(np.arange(len(texts)), lengths)
    s = letters(points)
    n_letters = np.bincount(text[s > 0], minlength=len(texts))
    inner = np.r_[True, s[:-1] == 0]
    keep = (s > 0) | ~inner  # one boundary after each run of letters; the text begins with one as well
    s, text = s[keep], text[keep]
    begins = np.r_[True, text[1:] != text[:-1]] if len(s) else np.zeros(0, bool)
    at = np.arange(len(s)) + np.cumsum(begins)
    padded, owner = np.zeros(len(s) + int(begins.sum()), np.int32), np.zeros(len(s) + int(begins.sum()), np.int64)
    padded[at] = s
    owner[at] = text
    owner[at[begins] - 1] = text[begins]
    if len(padded) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3), np.int32), n_letters
    alphabet, code = np.unique(padded, return_inverse=True)
    n = len(alphabet)
    key = (code[:-2].astype(np.int64) * n + code[1:-1]) * n + code[2:]
    same = (owner[:-2] == owner[2:]) & (padded[1:-1] > 0)
    key, owner = key[same], owner[:-2][same]
    if n**3 <= DENSE:
        different = np.flatnonzero(np.bincount(key, minlength=1))
        place = np.zeros(n**3, np.int64)
        place[different] = np.arange(len(different))
        index = place[key]
    else:
        different, index = np.unique(key, return_inverse=True)
    triples = np.stack([alphabet[different // (n * n)], alphabet[different // n % n], alphabet[different % n]], 1)
    return owner, index, triples, n_letters


def bound(triples: np.ndarray) -> np.ndarray:
    """The vector of each n-gram."""
    alphabet, code = np.unique(triples, return_inverse=True)
    code = code.reshape(triples.shape)
    v = np.stack([vector(a) for a in alphabet]) if len(alphabet) else np.zeros((0, DIMENSIONS), np.int8)
    return np.roll(v, 2, 1)[code[:, 0]] * np.roll(v, 1, 1)[code[:, 1]] * v[code[:, 2]]


def bundles(texts: list[str | None], groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bundle of each text (or of each group of texts), and each text's number of letters; a long text alone is taken in pieces."""
    if len(texts) == 1 and len(texts[0] or "") > SCAN:
        found = ((v.astype(np.float64), n) for v, n in map(bundle, pieces(texts[0])))
        out, n_letters = next(found)
        for v, n in found:
            out += v
            n_letters = n_letters + n
        return out, n_letters
    return bundle(texts, groups)


def bundle(texts: list[str | None] | str, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    texts = [texts] if isinstance(texts, str) else texts
    owner, index, triples, n_letters = trigrams(texts)
    rows = len(texts) if groups is None else int(groups.max(initial=-1)) + 1
    owner = owner if groups is None else groups[owner]
    out = np.zeros((rows, DIMENSIONS), np.float32 if groups is None else np.float64)
    step = 8192
    for lo in range(0, len(triples), step):  # some n-grams at a time: their vectors and counts stay small
        m = min(step, len(triples) - lo)
        mine = slice(None) if m == len(triples) else (index >= lo) & (index < lo + m)
        counts = np.bincount(owner[mine] * m + index[mine] - lo, minlength=rows * m).reshape(rows, m)
        out += counts.astype(out.dtype) @ bound(triples[lo : lo + m]).astype(out.dtype)
    return out, n_letters


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their bundles, of labelled (lang, text); each task adds up what it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in parts(texts):
                names = sorted(set(langs[lo:hi]))
                found, _ = bundles(texts[lo:hi], np.array([names.index(x) for x in langs[lo:hi]]))
                for name, v in zip(names, found, strict=False):
                    sums[name] = sums.get(name, 0) + v.astype(np.int64)
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(v)], names=["lang", "dimension", "total"])

    tasks = labelled.select("lang", "text").mapInArrow(run, "lang string, dimension int, total long")
    rows = tasks.groupBy("lang", "dimension").agg(F.sum("total").alias("total")).toArrow()
    names = rows.column(0).to_pylist()
    langs = sorted(set(names))
    out = np.zeros((len(langs), DIMENSIONS))
    place = {x: i for i, x in enumerate(langs)}
    out[[place[x] for x in names], rows.column(1).to_numpy()] = rows.column(2).to_numpy()
    some = np.linalg.norm(out, axis=1) > 0
    return [x for x, s in zip(langs, some, strict=True) if s], out[some]


def centred(prototypes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What all languages share (a unit vector, or 0 if there is only one), and the unit vectors of what is left of each."""
    unit = prototypes / np.linalg.norm(prototypes, axis=1, keepdims=True)
    if len(unit) < 2:
        return np.zeros(DIMENSIONS), unit
    mean = unit.mean(0)
    mean /= np.linalg.norm(mean) or 1
    rest = unit - np.outer(unit @ mean, mean)
    return mean, rest / np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str]) -> DataFrame:
    """keep, lang_pred and score."""
    langs, prototypes = model
    held = docs.sparkSession.sparkContext.broadcast((langs, *centred(prototypes)) if langs else None)

    def run(x: dict[str, pa.Array]) -> dict[str, pa.Array]:
        texts = x["text"].to_pylist()
        if held.value is None:
            return {"lang_pred": pa.array([UNKNOWN] * len(texts)), "score": pa.array([0.0] * len(texts))}
        names, mean, profiles = held.value
        names = np.array([*names, UNKNOWN], object)
        best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for lo, hi in parts(texts):
            v, n_letters = bundles(texts[lo:hi])
            v = v.astype(np.float64)
            v -= np.outer(v @ mean, mean)
            cosine = (v @ profiles.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            best[lo:hi] = np.where(n_letters > 0, cosine.argmax(1), len(names) - 1)
            score[lo:hi] = np.where(n_letters > 0, np.clip(cosine.max(1), 0, 1), 0)
        return {"lang_pred": pa.array(names[best], pa.string()), "score": pa.array(score)}

    return arrow_map(docs, keep, ["text"], run, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def fitted(docs: DataFrame, folds: int = 4, held_out: int = 2) -> tuple[list[str], np.ndarray]:
    return train(docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(fold_of(folds) != held_out, F.lit(True))))
