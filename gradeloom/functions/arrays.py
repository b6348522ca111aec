"""Array columns: scores, word vectors, log entries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def argmax(scores: Column) -> Column:
    """Class with the highest score; the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors; null if one of them is zero or missing."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def every_nth(values: Column, start: int = 1, step: int = 3) -> Column:
    """Entries start, start + step, ... of an array, counted from 0."""
    return F.filter(values, lambda _, i: (i >= start) & ((i - start) % step == 0))
