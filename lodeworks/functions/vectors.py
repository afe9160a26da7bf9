"""Vector arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x / by)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def deviation(n: Column, sums: Column, squares: Column) -> Column:
    """Population standard deviation of each dimension; rounding below zero counts as zero."""
    return F.zip_with(sums, squares, lambda s, q: F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))))


def normalised_distance(point: Column, centroid: Column, sigma: Column) -> Column:
    """Root of the summed squares of (centroid - point) / sigma; null if a sigma is zero."""
    gaps = F.zip_with(F.zip_with(centroid, point, lambda c, x: c - x), sigma, lambda g, s: F.pow(F.try_divide(g, s), F.lit(2.0)))
    return F.sqrt(total(gaps))
