"""Scores and other arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_score(weight: Column, tf: Column, length: Column, average: Column) -> Column:
    """BM25 of one term in one passage; an average of 0 counts as 1."""
    mean = F.when(average == 0, F.lit(1.0)).otherwise(average)
    return weight * tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * length / mean))


def dot(a: Column, b: Column) -> Column:
    """Product of two vectors in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """A norm of zero counts as one."""
    one = lambda x: F.when(x == 0, F.lit(1.0)).otherwise(x)
    return dot(a, b) / (one(F.sqrt(dot(a, a))) * one(F.sqrt(dot(b, b))))


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def vector_problem(vector: Column, dimensions: int) -> Column:
    """Why a vector cannot be stored; null if it can."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(vector.isNull() | (F.size(vector) != dimensions), F.lit("wrong length"))
        .when(bad, F.lit("not finite"))
        .when(F.forall(vector, lambda x: x == 0), F.lit("all zero"))
    )


def half_up(x: Column, digits: int) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def two_figures(n: Column) -> Column:
    """A count rounded to two significant figures from 100 on."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(n, F.lit(1)).cast("double"))) - 1)
    return F.when(n < 100, n.cast("long")).otherwise((F.floor(n / step + 0.5) * step).cast("long"))
