"""Distances between arrays of doubles, and similarities of sets by their sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def mahalanobis(v: Column, centre: Column, std: Column) -> Column:
    """Diagonal; where the deviation is 0 it counts as 1."""
    scaled = F.zip_with(F.zip_with(v, centre, lambda x, c: x - c), std, lambda d, s: d / F.when(s == 0, 1.0).otherwise(s))
    return F.sqrt(total(F.transform(scaled, lambda d: d * d)))


def deviation(n: Column, s: Column, sq: Column) -> Column:
    """sqrt(|sumsq / n - (sum / n) ** 2|)."""
    return F.sqrt(F.abs(sq / n - (s / n) * (s / n)))


def jaccard(both: Column, left: Column, right: Column) -> Column:
    return both / (left + right - both)


def cosine(both: Column, left: Column, right: Column) -> Column:
    """Of Boolean vectors."""
    return both / F.sqrt((left * right).cast("double"))


def percent_error(estimate: Column, truth: Column) -> Column:
    return F.try_divide((estimate - truth) * 100.0, truth)
