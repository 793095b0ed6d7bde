"""Chunked running values against plain windows, with one key holding most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quietgate.functions.running import running


def test_running_equals_a_plain_window_on_a_hot_key(spark):
    rng = random.Random(6)
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 9), i, rng.randint(0, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, t int, v int")
    chunk = F.floor(F.col("t") / 100)
    measures = {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v"))}
    for inclusive in (True, False):
        w = Window.partitionBy("k").orderBy("t").rowsBetween(
            Window.unboundedPreceding, 0 if inclusive else -1
        )
        plain = df.select("*", F.sum("v").over(w), F.max("v").over(w), F.min("v").over(w))
        chunked = running(df, ["k"], ["t"], chunk, measures, inclusive)
        got = chunked.select("k", "t", "v", "s", "hi", "lo")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_no_task_sees_the_whole_hot_key(spark):
    df = spark.range(8000).select(F.lit(1).alias("k"), "id", (F.col("id") % 7).alias("v"))
    out = running(df, ["k"], ["id"], F.floor(F.col("id") / 250), {"s": ("sum", F.col("v"))})
    spread = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 8000
