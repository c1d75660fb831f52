"""Toxicity: the two models against a plain statement of their formulas, reading of words, scores of held-out documents."""

import collections
import math

import duckdb
import pytest

from passagelake.llm import queries as Q
from passagelake.llm import toxicity as X

D = X.DISCOUNT


def plain_differences(texts):
    """A function of a word: the difference of its log-likelihoods, from (words, toxic) of each text."""
    n = [collections.Counter(), collections.Counter()]
    for words, toxic in texts:
        for w in set(words):
            s = w.encode() + b"\0"
            for i in range(len(s) + 1):
                n[toxic][s[:i]] += 1
    grown = set(n[0]) | set(n[1])
    after = lambda h: [g for g in grown if len(g) == len(h) + 1 and g[:-1] == h]
    pairs = collections.Counter((g[-2] if len(g) > 1 else 0, g[-1]) for g in grown if g)
    before = collections.Counter(x for _, x in pairs)
    size = [sum(t == c for _, t in texts) for c in (0, 1)]
    prior = [X.PRIOR * s / min(size) for s in size]

    def p_byte(x):
        return (max(before[x] - D, 0) + D * len(before) / 256) / sum(before.values())

    def p_pair(y, x):
        of = [v for (a, _), v in pairs.items() if a == y]
        return (max(pairs[y, x] - D, 0) + D * len(of) * p_byte(x)) / sum(of)

    def p(h, x, c):
        g = h + bytes([x])
        both = lambda k: n[0][k] + n[1][k]
        shared = (max(both(g) - D, 0) + D * len(after(h)) * p_pair(h[-1] if h else 0, x)) / both(h)
        kinds = sum(n[c][k] > 0 for k in after(h))
        return (max(n[c][g] - D, 0) + (D * kinds + prior[c]) * shared) / (n[c][h] + prior[c])

    def left(h, c):
        kinds = sum(n[c][k] > 0 for k in after(h))
        return (D * kinds + prior[c]) / (n[c][h] + prior[c])

    def differ(w):
        s, out = w.encode() + b"\0", 0.0
        for i in range(len(s)):
            if s[: i + 1] not in grown:
                return out + math.log(left(s[:i], 1) / left(s[:i], 0))
            out += math.log(p(s[:i], s[i], 1) / p(s[:i], s[i], 0))
        return out

    return differ


def model_of(spark, rows):
    return X.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))


@pytest.fixture(scope="module")
def taught(spark):
    rows = [(i, f"plain ordinary words here {'vile' + 'abcdefgh'[i % 8] if i % 3 == 0 else 'nice'} ärger {'von' if i % 2 else 'vor'} 悪い言葉", int(i % 3 == 0)) for i in range(120)]
    return rows, model_of(spark, rows)


def counted_rows(spark, rows):
    part = spark.createDataFrame(rows, "doc_id long, text string, toxic int").selectExpr("*", f"pmod(xxhash64('calibrate', doc_id), {X.CALIBRATE}) AS part")
    return [r for r in part.collect() if r["part"] != 0]


def split(text):
    return [w for part in X.words(text) for w in part]


def test_evidence_equals_the_plain_formula(spark, taught):
    rows, model = taught
    differ = plain_differences([(split(r["text"]), r["toxic"]) for r in counted_rows(spark, rows)])
    texts = ["vilea", "vilez vilea nice", "vile", "unknown", "v", "vileavilea", "ärger 悪い言葉", "plain " * 40 + "vileb", "", None, "?!", "vilea vilea vilea"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("id", X.text_id())
    found = {r["id"]: r["evidence"] for r in X.evidence(docs, model).collect()}
    for r in docs.collect():
        words = split(r["text"] or "")
        expected = sum(max(0.0, differ(w) - X.MARGIN) for w in words) / max(len(words), X.LEAST_WORDS)
        assert found.get(r["id"], 0.0) == pytest.approx(expected, abs=1e-8), r["text"]
    assert differ("vilea") > X.MARGIN and differ("vilez") > X.MARGIN  # an ending that was never seen


def test_probabilities_of_seen_and_unseen_bytes_add_up(taught):
    """For every short beginning the shared model gives all bytes together 1."""
    spelling = taught[1].spelling
    for y, row in enumerate(spelling.after):
        assert sum(row) == pytest.approx(1.0) or not any(row), y


def test_words():
    assert split("Don't STOP, ärger_x 42") == ["don", "t", "stop", "ärger", "x", "42"]
    assert split("悪い言葉だ") == ["悪い言葉", "い言葉だ", "言葉だ", "葉だ", "だ"]
    assert split("x" * 70) == ["x" * 32, "x" * 32, "x" * 6]
    long = "один два " * 200_000
    assert collections.Counter(split(long)) == {"один": 200_000, "два": 200_000}
    assert all(len(p) <= X.SLICE // 8 for p in X.words(long))


def test_copies_of_a_text_count_once(spark):
    rows = [(i, "plain ordinary text", 0) for i in range(0, 60, 2)] + [(i, f"a vile text {i}", 1) for i in range(1, 60, 2)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 1)], "doc_id long, toxic int")
    known = X.label_rows(docs, labels, 3, 1).toPandas()
    copies = known[known.text == "plain ordinary text"]
    assert copies.doc_id.tolist() == [0] and copies.toxic.tolist() == [1]  # toxic as one label of one copy is
    assert len(known) > 10 and known.text.is_unique


def test_held_out_documents(spark):
    """Labels are wrong for some documents: 4 in 100 toxic ones hold no toxic word."""
    sf = "/root/testdata/sf0.1"
    labels = duckdb.sql(f"SELECT doc_id, lang, toxic FROM '{sf}/labels.parquet' JOIN '{sf}/documents.parquet' USING (doc_id)").df()
    got = Q.op3_toxicity(spark, sf).toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    toxic = held[held.toxic == 1]
    assert toxic.predicted.mean() >= 0.9
    for _, rows in toxic.groupby("lang"):
        assert len(rows) < 20 or rows.predicted.mean() >= 0.9
    assert held[held.toxic == 0].predicted.mean() < 0.02


def test_kept_drops_the_rejected_alone(spark, taught):
    rows, model = taught
    model.edges, model.values = [0.0, 0.1, 0.2], [0.0, 1.0, 1.0]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(["vilea vileb vilec", "plain words", None, "", "vilea vileb vilec"])], "doc_id long, text string, marked string, row string")
    left = X.kept(docs, model, X.TOXIC)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3]
