"""Bounds of what is broadcast or reaches the driver, checked before it does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a table that is broadcast or collected as a model.
MOST_CHARS = 16_000_000


def small_enough(df: DataFrame, size_col: str, most: int = MOST_CHARS) -> bool:
    """Whether the sizes of df's rows in size_col, with 16 more for each row, add up to `most` or less."""
    return (df.select(F.sum(F.col(size_col) + 16)).first()[0] or 0) <= most


def sampled(df: DataFrame, by: str, most: int) -> DataFrame:
    """About `most` rows of df, chosen by the hash of column by alone; all rows of a smaller df.

    The same rows are chosen at each run, in any partitioning. Rows of equal `by` are chosen together, so
    it should be a key.
    """
    n = df.count()
    if n <= most:
        return df
    span = 1 << 30
    return df.where(F.pmod(F.xxhash64(by), F.lit(span)) < int(span * most / n))
