"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, stored

#: A partition's number starts at this bit of ``monotonically_increasing_id``.
_PARTITION_BIT = 33


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc_id``, the named columns and ``text``, a null text being the empty one."""
    return docs.select("doc_id", *columns, F.coalesce("text", F.lit("")).alias("text"))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place, from 0, in the order given: equal rows in any order.

    Rows are dealt by ranges and numbered in their range; only one count a range (as many as
    there are partitions) passes through one task. ``rows`` should be narrow: it is stored.
    """
    dealt = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    stored = cut(dealt)
    sizes = stored.groupBy(F.shiftright("_place", _PARTITION_BIT).alias("_part")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    within = F.col("_place").bitwiseAND((1 << _PARTITION_BIT) - 1)
    return (
        stored.withColumn("_part", F.shiftright("_place", _PARTITION_BIT))
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + within)
        .drop("_place", "_part", "_start")
    )


def slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose strings have about ``size`` bytes at most.

    A longer text is a run of its own; every row is in exactly one run.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, length in enumerate(sizes):
        if i > start and total + length > size:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += length
    if start < len(sizes):
        yield batch.slice(start)


def record(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def remembered(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once in a Python worker's life, not once a task.

    Functions are shipped by value, so a cache in their own module would start empty each time.
    """
    kept = sys.modules.setdefault("_quietgate_worker", types.ModuleType("_quietgate_worker")).__dict__
    found = kept.setdefault("kept", {})
    if key not in found:
        found[key] = make()
    return found[key]


def release(*keep: str) -> None:
    """Drops what this worker remembers under other names than these, and gives freed memory back.

    A worker outlives its task: what the operator before it had made would stay beside this one's.
    """
    kept = sys.modules.get("_quietgate_worker")
    found = kept.__dict__.get("kept", {}) if kept is not None else {}
    for key in [k for k in found if (k if isinstance(k, str) else k[0]) not in keep]:
        del found[key]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library: freed memory stays in the process
        pass


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Run, *keep: str) -> Run:
    """``run`` in a worker that holds only what is named of earlier tasks, and little after it."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(*keep)
        yield from run(batches)
        release(*keep)

    return tidied


#: Bytes of a batch of rows on its way to a Python worker.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python end by bytes too: by rows alone, 10,000 long texts are one batch.

    The session keeps the setting, as its frames run later; one that it has already stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


#: A Bloom filter of longs has at most so many bits, whatever the number of longs (8 MiB).
BLOOM_BITS = 26
_BLOOM_HASHES = 4


def _bloom_places(values: np.ndarray, bits: int, i: int) -> np.ndarray:
    odd = np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & (2**64 - 1) | 1)
    mixed = values.astype(np.uint64) * odd
    return (mixed ^ (mixed >> np.uint64(29))) * odd >> np.uint64(64 - bits)


def long_bloom(rows: DataFrame, column: str) -> np.ndarray:
    """Words of a Bloom filter of a long column, of 16 bits a value up to ``2^BLOOM_BITS`` bits.

    Its size is bounded, so it may be broadcast; what it passes must be tested exactly later,
    and a filter too small for its values only passes more.
    """
    n = rows.agg(F.approx_count_distinct(column)).first()[0]
    bits = min(BLOOM_BITS, max(16, (16 * n).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.int64()), ("bits", pa.int64())])
        for batch in batches:
            values = batch.column(0).to_numpy()
            at = np.concatenate([_bloom_places(values, bits, i) for i in range(_BLOOM_HASHES)])
            words, mask = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
            yield record(schema, (words.astype(np.int64), mask.view(np.int64)))

    placed = rows.select(column).mapInArrow(tidy(place), "word long, bits long")
    found = placed.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return words


def in_bloom(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    bits = int(len(words)).bit_length() + 5
    found = np.ones(len(values), bool)
    for i in range(_BLOOM_HASHES):
        at = _bloom_places(values, bits, i)
        found &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    return found
