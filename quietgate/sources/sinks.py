"""Sinks for corpora and metadata logs."""

from __future__ import annotations

import sys
from itertools import groupby

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import stored
from ..functions.running import running
from ..operators.aggregates import split_manifest

# Executors need not have this package installed: ship its helpers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Folders that many small files are dealt to.
FOLDERS = 1024
# Slots that keys are hashed to; rows of a slot that holds a repeated key are brought together.
SLOTS = 1 << 16
# The only columns an audit log may hold: metadata, never content.
AUDIT_COLUMNS = [
    "event_id", "timestamp_ms", "host", "method", "body_len", "reason", "rules",
    "policy_revision", "action",
]


def write_splits(df: DataFrame, out: str) -> DataFrame:
    """JSON lines in one directory per split; an existing target is refused.

    Returns the manifest computed from what was written, whose hash does not depend on how the
    rows fell into files.
    """
    df.write.mode("errorifexists").partitionBy("split").json(out)
    written = df.sparkSession.read.schema(df.schema).json(out)
    return split_manifest(written.select(*df.columns))


def _dealt(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``folder, name, text`` of the rows alone in their file, and of the rows that may share one.

    Keys are counted by name; the slots of those that repeat, ``SLOTS`` at most, go to every task.
    A row whose slot holds none of them is alone in its file for certain.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    folder = F.pmod(F.xxhash64(key), F.lit(FOLDERS))
    rows = df.select(folder.alias("folder"), name.alias("name"), F.col(text).alias("text"))
    rows = rows.withColumn("_slot", F.pmod(F.xxhash64("name"), F.lit(SLOTS)))
    repeated = rows.groupBy("_slot", "name").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    slots = F.broadcast(stored(repeated.select("_slot").distinct()))
    alone, several = (rows.join(slots, "_slot", how).drop("_slot") for how in ("left_anti", "left_semi"))
    return alone, several


def write_texts(df: DataFrame, out: str, key: str, text: str) -> None:
    """A text file ``folder=<n>/<key>=<value>.txt`` for each (whole-number) key under the URI ``out``.

    Rows of one key share its file, a line each; a null text is an empty line. The tasks write the
    files in place, so nothing is left for the driver to move one by one, and a task run again
    writes the same files over. Texts are shuffled only where keys repeat; the others are written
    from where they lie.
    """

    def write(rows) -> None:
        target, root = fs.FileSystem.from_uri(out)
        made = set()
        for (folder, value), lines in groupby(rows, lambda r: (r.folder, r.name)):
            if folder not in made:
                target.create_dir(f"{root}/folder={folder}", recursive=True)
                made.add(folder)
            with target.open_output_stream(f"{root}/folder={folder}/{key}={value}.txt") as file:
                for line in lines:
                    file.write(f"{'' if line.text is None else line.text}\n".encode())

    alone, several = _dealt(df, key, text)
    alone.foreachPartition(write)
    several.repartition("folder").sortWithinPartitions("folder", "name").foreachPartition(write)


def sequenced(events: DataFrame, after: int = 0, chunk_ms: int = 3_600_000) -> DataFrame:
    """Number events consecutively in time order, without sorting them all in one task."""
    if "event_id" not in events.columns:
        events = events.withColumn("event_id", F.lit(None).cast("string"))
    order = ["timestamp_ms", *[c for c in ("host", "method", "body_len", "event_id") if c in events.columns]]
    numbered = running(
        events,
        [],
        order,
        F.floor(F.col("timestamp_ms") / chunk_ms),
        {"_seq": ("sum", F.lit(1))},
    )
    return numbered.withColumn("event_id", F.col("_seq") + after).drop("_seq")


def append_audit(events: DataFrame, path: str, new: bool = True) -> None:
    """Write audit records numbered from 1 (new log) or from the log's last number.

    A new log refuses an existing target. Columns outside the metadata list are an error, not
    silently dropped.
    """
    extra = sorted(set(events.columns) - set(AUDIT_COLUMNS))
    if extra:
        raise ValueError(f"not metadata columns: {', '.join(extra)}")
    last = 0
    if not new:
        stored = events.sparkSession.read.parquet(path)
        last = stored.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("m")).first()["m"]
    mode = "errorifexists" if new else "append"
    sequenced(events, last).write.mode(mode).parquet(path)
