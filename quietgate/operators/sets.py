"""Set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_splits(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides; must be empty."""
    return a.select(key).intersect(b.select(key))


def set_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with the side; empty when the two are equal as multisets."""
    cols = a.columns
    left = a.exceptAll(b.select(*cols)).withColumn("side", F.lit("left"))
    right = b.select(*cols).exceptAll(a).withColumn("side", F.lit("right"))
    return left.unionByName(right)


def dedup_exact(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key tuples; which copy stays is arbitrary (see ``first_duplicate_wins``)."""
    return df.dropDuplicates(list(keys))
