"""Right-closed length bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Upper edges of the length buckets; the last bucket is open.
BUCKET_EDGES = (128, 256, 384, 512)
# Edges of the bounded length bins.
BIN_EDGES = (0, 128, 256, 384, 512, 1500)


def length_bucket(length: Column, edges: Sequence[int] = BUCKET_EDGES) -> Column:
    """Bucket number from 1; an edge belongs to the bucket below it."""
    bucket = F.when(length <= edges[0], 1)
    for number, edge in enumerate(edges[1:], start=2):
        bucket = bucket.when(length <= edge, number)
    return bucket.when(length > edges[-1], len(edges) + 1)


def cut(value: Column, edges: Sequence[int] = BIN_EDGES) -> Column:
    """Bin (left, right] of a value as a struct; null outside of all bins."""
    bins = [
        ((value > left) & (value <= right), F.struct(F.lit(left).alias("bin_left"), F.lit(right).alias("bin_right")))
        for left, right in zip(edges, edges[1:])
    ]
    chosen = F.when(*bins[0])
    for inside, interval in bins[1:]:
        chosen = chosen.when(inside, interval)
    return chosen


def bin_label(left: Column, right: Column) -> Column:
    """Text such as "0 - 128"; null if an end is missing."""
    return F.concat(left.cast("long").cast("string"), F.lit(" - "), right.cast("long").cast("string"))


def range_label(low: Column, high: Column) -> Column:
    """Observed range such as "3-127", ends rounded to whole numbers."""
    ends = [F.bround(end.cast("double"), 0).cast("long").cast("string") for end in (low, high)]
    return F.concat(ends[0], F.lit("-"), ends[1])
