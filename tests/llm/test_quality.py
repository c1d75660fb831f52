"""Cutoffs follow each group's own distribution."""

import math

import numpy as np
import pytest

from passagelake.llm import quality as X


def table(spark, rows):
    """rows: (lang, source, value) as measured documents of 100 words, 10 lines and 500 letters."""
    return spark.createDataFrame([(lang, source, 100, 10, 500, float(v)) for lang, source, v in rows], "lang string, source string, n_words long, n_lines long, n_letters long, symbol_ratio double")


ONE = {"symbol_ratio": X.METRICS["symbol_ratio"]}


def limits(spark, rows):
    return {(r["lang"], r["source"]): r["symbol_ratio_high"] for r in X.cutoffs(table(spark, rows), metrics=ONE).collect()}


def test_a_group_of_another_distribution_gets_another_cutoff(spark):
    rng = np.random.default_rng(1)
    prose = [("en", "prose", 0.0)] * 4000
    code = [("en", "code", v) for v in rng.normal(0.8, 0.05, 4000)]
    got = limits(spark, prose + code)
    assert got["en", "prose"] == pytest.approx(X.FENCE / 100, rel=0.05)  # one symbol in a text of 100 words is the step
    assert 1.0 < got["en", "code"] < 1.6
    moved = limits(spark, prose + [(a, b, 2 * v) for a, b, v in code])
    assert moved["en", "prose"] == got["en", "prose"] and moved["en", "code"] == pytest.approx(2 * got["en", "code"], rel=0.05)


def test_quartiles_within_the_accuracy(spark):
    rng = np.random.default_rng(2)
    values = rng.lognormal(-2, 1, 20_000)
    found = X.quantiles(X.merged(X.sketches(table(spark, [("en", "a", v) for v in values]), ["lang"], ["symbol_ratio"]), ["lang"]), ["lang"]).first()
    for i in (1, 2, 3):
        assert found[f"q{i}"] == pytest.approx(np.quantile(values, i / 4, method="inverted_cdf"), rel=2 * X.ACCURACY)


def test_sketches_merge_to_the_sketch_of_all(spark):
    rows = [("en", "ab"[i % 2], (i % 7) / 10) for i in range(100)]
    fine = X.sketches(table(spark, rows), ["lang", "source"], ["symbol_ratio"])
    whole = X.sketches(table(spark, rows), [], ["symbol_ratio"])
    key = lambda df: sorted((r["metric"], r["bucket"] if r["bucket"] is not None else -math.inf, r["n"]) for r in df.collect())
    assert key(X.merged(fine, [])) == key(whole)


def test_small_groups_lean_on_their_language(spark):
    many = [("en", "large", 0.5 + 0.1 * ((i % 101) / 100)) for i in range(5000)]
    got = limits(spark, many + [("en", "tiny", 9.0)] * 3)
    large = got["en", "large"]
    assert got["en", "tiny"] == pytest.approx(large, rel=0.1)
    # With more documents of its own the same group stands for itself.
    assert limits(spark, many + [("en", "tiny", 9.0)] * 5000)["en", "tiny"] > 9


def test_verdicts_move_with_the_group(spark):
    text = "plain words of a text that is long enough to be judged by the adaptive rules of its own group and it has some symbols too "
    noisy = text + "# $ % & * | < > # % * <"
    rows = [(i, text, "en", "prose") for i in range(200)] + [(200, noisy, "en", "prose")] + [(1000 + i, noisy, "en", "code") for i in range(200)] + [(1200, text, "en", "code")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'clash' AS n_lines")
    got = {r["doc_id"]: r for r in X.filtered(docs).collect()}
    assert not got[200]["kept"] and "symbol_ratio" in got[200]["outside"]
    assert all(got[i]["kept"] for i in [*range(200), *range(1000, 1200)])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (None, "word " * 30, None, "a"), (3, "x" * 1_000_000, "en", None)], "doc_id long, text string, lang string, source string")
    got = X.filtered(docs).collect()
    assert len(got) == 5 and all(r["base_failed"] and not r["kept"] for r in got)
    assert X.filtered(docs.limit(0)).count() == 0
