"""State of a stream by key, kept as files: what a micro-batch writes grows with the batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KeyedState:
    """The newest row of each key, for ``foreachBatch`` writers.

    Each epoch writes the rows that it changes as a delta; every ``compact`` epochs the newest
    rows of all keys are written whole, and reading starts there. An epoch's folders depend on
    the epochs before it alone and are written over, so a failed micro-batch can be repeated.
    Every epoch from 0 on must be written, an empty one too.
    """

    def __init__(self, path: str, schema: T.StructType, keys: Sequence[str], compact: int = 16) -> None:
        self.path, self.keys, self.compact = path, list(keys), compact
        self.columns = schema.names
        self.schema = T.StructType([*schema.fields, T.StructField("_epoch", T.LongType())])

    def _paths(self, epoch: int) -> list[str]:
        """Folders that hold the state as epoch ``epoch`` finds it."""
        whole = epoch - epoch % self.compact
        deltas = [f"{self.path}/delta={e}" for e in range(whole, epoch)]
        return ([f"{self.path}/whole={whole}"] if whole else []) + deltas

    def newest(self, spark: SparkSession, epoch: int) -> DataFrame:
        """The newest row of each key before epoch ``epoch``, as many rows as keys: joined by
        shuffle, never broadcast."""
        paths = self._paths(epoch)
        if not paths:
            return spark.createDataFrame([], self.schema).select(*self.columns)
        rows = spark.read.schema(self.schema).parquet(*paths)
        return (
            rows.groupBy(*self.keys)
            .agg(F.max_by(F.struct(*self.columns), "_epoch").alias("_row"))
            .select("_row.*")
            .hint("merge")
        )

    def write(self, epoch: int, changed: DataFrame, keep: Column | None = None) -> None:
        """Write what epoch ``epoch`` changed, one row a key; when the state is written whole,
        rows not to ``keep`` are forgotten."""
        spark = changed.sparkSession
        told = changed.select(*self.columns, F.lit(epoch).cast("long").alias("_epoch"))
        told.write.mode("overwrite").parquet(f"{self.path}/delta={epoch}")
        if (epoch + 1) % self.compact == 0:
            whole = spark.read.schema(self.schema).parquet(*self._paths(epoch), f"{self.path}/delta={epoch}")
            merged = whole.groupBy(*self.keys).agg(F.max_by(F.struct(*self.schema.names), "_epoch").alias("_row"))
            rows = merged.select("_row.*")
            rows = rows if keep is None else rows.filter(keep)
            rows.write.mode("overwrite").parquet(f"{self.path}/whole={epoch + 1}")
