"""Arithmetic on vectors as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from thicket.config import EPS


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(EPS)) * (norm(b) + F.lit(EPS)))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """Of length one, unless it has none."""
    n = norm(a)
    return F.when(n > 1e-12, F.transform(a, lambda x: x / n)).otherwise(a)


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def effective_rank(spectrum: Column) -> Column:
    """exp of the entropy of the normalised spectrum; 1 for an empty one."""
    mass = total(F.transform(spectrum, lambda x: F.greatest(x, F.lit(0.0)))) + F.lit(EPS)
    p = F.filter(F.transform(spectrum, lambda x: F.greatest(x, F.lit(0.0)) / mass), lambda x: x > EPS)
    return F.exp(-F.aggregate(p, F.lit(0.0), lambda s, x: s + x * F.ln(x + F.lit(EPS))))


def anisotropy(spectrum: Column) -> Column:
    return F.coalesce(F.array_max(spectrum), F.lit(0.0)) / (total(spectrum) + F.lit(EPS))


def usable(v: Column, dim: int) -> Column:
    """Of the right length, all numbers finite, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
