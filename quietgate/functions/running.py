"""Running aggregates and exact order statistics that survive one very large key.

A plain ``OVER (PARTITION BY key ORDER BY t)`` sends a key to one task. Here a key is cut into
ordered chunks: each chunk is aggregated, chunk totals are accumulated (few rows), and only then
rows are visited within their own chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MERGE = {
    "sum": (F.sum, lambda a, b: a + b),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    chunk: Column,
    measures: Mapping[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Add one running value per measure ``name -> (sum|max|min, expression)``.

    ``chunk`` must be non-decreasing along ``order`` within a key. With ``inclusive=False`` the
    current row is left out (NULL before the first value).
    """
    work = df.withColumn("_chunk", chunk)
    totals = work.groupBy(*keys, "_chunk").agg(
        *[_MERGE[kind][0](expr).alias(f"_t_{n}") for n, (kind, expr) in measures.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = totals.select(
        *keys,
        "_chunk",
        *[
            _MERGE[kind][0](f"_t_{n}").over(earlier).alias(f"_b_{n}")
            for n, (kind, _e) in measures.items()
        ],
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    joined = work.join(before, [*keys, "_chunk"])
    for n, (kind, expr) in measures.items():
        agg, merge = _MERGE[kind]
        here = agg(expr).over(within)
        both = merge(F.col(f"_b_{n}"), here)
        joined = joined.withColumn(n, F.coalesce(both, here, F.col(f"_b_{n}")))
    return joined.drop("_chunk", *[f"_b_{n}" for n in measures])


def magnitude(value: Column, steps: int = 256) -> Column:
    """Chunk number that never decreases with ``value``: ``steps`` chunks per factor of two.

    Infinities have the first and last chunk; NaN, which orders above them, one of its own.
    """
    v = value.cast("double")
    most = 2200 * steps
    endless = F.abs(v) == float("inf")
    # The offset exceeds the chunk number of the smallest double, so each side of zero keeps sign.
    size = F.floor(F.log2(F.abs(v)) * steps) + 1100 * steps
    return (
        F.when(F.isnan(v), F.lit(most + 1))
        .when(endless, F.when(v > 0, F.lit(most)).otherwise(F.lit(-most)))
        .when(v == 0, F.lit(0))
        .otherwise(F.signum(v).cast("long") * size)
    )


def order_statistics(
    df: DataFrame, by: Sequence[str], value: str, ranks: Mapping[str, Column]
) -> DataFrame:
    """Exact values at zero-based ``ranks`` (expressions over the group size ``n``), per group.

    Equal values are counted before anything is ordered; positions then come from running
    counts over chunks of value, so a group of any size is never sorted in one task or held in
    memory. NULLs are left out (by their zero count: a filter would be pushed into the caller's
    expressions and evaluate them twice).
    """
    counted = (
        df.groupBy(*by, F.col(value).alias("_v")).agg(F.count(value).alias("_c")).filter("_c > 0")
    )
    sizes = counted.groupBy(*by).agg(F.sum("_c").alias("n"))
    placed = running(counted, list(by), ["_v"], magnitude(F.col("_v")), {"_hi": ("sum", F.col("_c"))})
    joined = placed.join(sizes, list(by)) if by else placed.join(F.broadcast(sizes))
    here = lambda rank: (rank < F.col("_hi")) & (rank >= F.col("_hi") - F.col("_c"))
    return joined.groupBy(*by).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(here(r), F.col("_v"))).alias(k) for k, r in ranks.items()],
    )
