"""Scores of answers against expected ones, for evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f1(expected: Column, answer: Column) -> Column:
    """F1 of two sets (arrays): 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(expected, answer))
    e, a = F.size(F.array_distinct(expected)), F.size(F.array_distinct(answer))
    return F.when((e == 0) & (a == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (e + a))


def within(expected: Column, answer: Column, tolerance: Column) -> Column:
    """1 if a number is off by at most the tolerance, else 0."""
    return F.when(F.abs(expected - answer) <= F.coalesce(tolerance, F.lit(0)), 1.0).otherwise(0.0)
