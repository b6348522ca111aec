"""First rows of a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows in the order of ``row_idx``."""
    return df.orderBy("row_idx").limit(n)
