"""Columns of vectors: norms, products, nested sizes, pooling, activations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Length 1; a zero vector stays zero."""
    n = F.greatest(norm(v), F.lit(TINY))
    return F.transform(doubles(v), lambda x: x / n)


def nested(v: Column, dim: int) -> Column:
    """The first `dim` coordinates, of length 1 again."""
    return unit(F.slice(v, 1, dim))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(TINY)) * F.greatest(norm(b), F.lit(TINY)))


def ladder(full: int, steps: tuple[int, ...] = (1024, 768, 512, 256, 128, 64, 32, 16, 8)) -> list[int]:
    """The nested sizes up to the full one, which is always in, falling."""
    return sorted({d for d in steps if d <= full} | {full}, reverse=True)


def sigmoid_margin(yes: Column, no: Column) -> Column:
    """The chance of 'yes' against 'no', from their logits."""
    return 1 / (1 + F.exp(no - yes))


def teacher_margin(positive: Column, negative: Column) -> Column:
    """How much higher the positive scores; a row without a negative has a margin of 0."""
    return positive - F.coalesce(negative, positive)


def activation(logit: Column) -> Column:
    """A sparse weight: log(1 + max(x, 0))."""
    return F.log1p(F.greatest(logit, F.lit(0.0)))
