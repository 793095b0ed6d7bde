"""Sorts, limits and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def latest_n(df: DataFrame, ts: str, n: int, tie: str | None = None) -> DataFrame:
    """Newest ``n`` rows; planned as TakeOrderedAndProject."""
    order = [F.desc(ts)] + ([F.desc(tie)] if tie else [])
    return df.orderBy(*order).limit(n)


def clamped_limit(df: DataFrame, n: int, order: str = "id") -> DataFrame:
    """Newest rows with the requested limit clamped to 1..500 when the plan is built."""
    return df.orderBy(F.desc(order)).limit(max(1, min(int(n), 500)))


def overview_top(events: DataFrame, n: int = 8, ts: str = "received_at") -> DataFrame:
    return latest_n(events, ts, n, "event_id")


def shuffle_key(key: Column, seed: int) -> Column:
    """Seeded order key with the same value on any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def deterministic_shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Reorder rows by a seeded hash of their id: a range sort, stable across partitionings."""
    return (
        df.withColumn("_order", shuffle_key(F.col(key), seed)).orderBy("_order", key).drop("_order")
    )


def shuffled_options(key: str, options: list[str], seed: int) -> Column:
    """Per-row order of a fixed option list, by hash of row id and option."""
    return F.transform(
        F.array_sort(
            F.transform(
                F.array(*[F.lit(o) for o in options]),
                lambda o: F.struct(
                    F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"), F.lit(":"), o)),
                    o.alias("option"),
                ),
            )
        ),
        lambda s: s["option"],
    )


def length_buckets(df: DataFrame, len_col: str, key: str, n: int) -> DataFrame:
    """Add ``batch``: rows by length, ties by ``key``, in batches of ``n``, so that batches pad little.

    Rows are numbered within range partitions and those are offset by the counts before them:
    one count a partition passes through one task, and equal lengths may span partitions.
    """
    order = [F.col(len_col), F.col(key)]
    placed = cut(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    # The low 33 bits number the rows of a partition; the high bits name the partition.
    part = F.shiftright("_row", 33)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    rank = F.col("_start") + F.col("_row").bitwiseAND((1 << 33) - 1)
    return (
        placed.withColumn("_part", part).join(starts, "_part")
        .withColumn("batch", F.floor(rank / n).cast("long"))
        .drop("_row", "_part", "_start")
    )
