"""Structured Streaming forms of scan, ingest, reports and throttling.

The batch operators they reuse are row-local or windowed. Where the batch form remembers for
ever, the stream form remembers for its watermark delay, and says so.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..functions import spans as S
from ..functions.clock import micros
from ..functions.lineage import cut, shared_folder
from ..operators.decide import effective_action
from ..operators.ingest import payload_hash
from ..operators.requests import inspect_requests
from ..operators.windows import throttle
from .keyed import KeyedState

# Executors need not have this package installed: ship its helpers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None
) -> DataFrame:
    """File-source stream under a fixed schema."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_scan(stream: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Scan arriving text; only rule metadata leaves."""
    spans = S.kept_spans(text)
    slim = F.transform(
        spans,
        lambda s: F.struct(
            S.rule_name(s["prio"]).alias("rule"),
            F.element_at(F.array(*[F.lit(r.severity) for r in S.RULES]), s["prio"] + 1).alias(
                "severity"
            ),
        ),
    )
    return stream.select(*keep, slim.alias("findings")).withColumn(
        "severity", S.max_severity(F.col("findings"))
    )


def stream_inspect(stream: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """Inspect arriving requests and, given policies, decide each under the one in force.

    ``policies`` is what is known when the stream starts; :func:`decision_sink` reads them anew
    for every micro-batch.
    """
    seen = inspect_requests(stream).withColumn("body_len", F.octet_length("body"))
    slim = seen.drop("body", "path", "content_type")
    return slim if policies is None else effective_action(slim, policies)


def decision_sink(path: str, policies: Callable[[SparkSession, int], DataFrame]):
    """``foreachBatch`` writer that decides inspected requests under the policies known by then.

    ``policies(spark, epoch)`` is called for every micro-batch, so a policy published while the
    stream runs holds from the next one on. The index of its periods is built for the batch; the
    requests are salted by their own values, so that one busy hour is many tasks.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        decided = effective_action(batch, policies(batch.sparkSession, epoch))
        decided.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def stream_dedup(stream: DataFrame, delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """First copy of each (device, event). Retries later than ``delay`` are no longer known."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(
        ["device_id", "event_id"]
    )


def conflict_sink(path: str, remember: int = 3600, compact: int = 16):
    """``foreachBatch`` writer of every arriving copy's status: ``path/rows`` holds them.

    A copy is ``new`` if it is the first of its event, by event time in the micro-batch that
    brings the event, else ``retry`` if its payload is that one's and ``conflict`` if not. Copies
    are aggregated by the least hash before they meet the state. A first payload is forgotten
    once arrivals are ``remember`` seconds past it. Events grow with the batch, so all joins are by
    shuffle.
    """
    key = ["device_id", "event_id"]

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        held = T.StructType(
            [*[batch.schema[c] for c in key], T.StructField("payload", T.StringType()), T.StructField("at", T.LongType())]
        )
        state = KeyedState(f"{path}/state", held, key, compact)
        copies = cut(
            batch.select(*key, payload_hash().alias("_h"), micros(batch, "ts").alias("_at"))
            .withColumn("_id", F.monotonically_increasing_id())
        )
        firsts = copies.groupBy(*key).agg(F.min(F.struct("_at", "_h", "_id")).alias("_first"))
        known = cut(firsts.join(state.newest(spark, epoch), key, "left"))
        fresh = F.col("payload").isNull()
        # Spark takes a checkpoint's size from its plan, too small here, and would broadcast it.
        told = copies.join(known.hint("merge"), key).select(
            *key,
            F.when(fresh & (F.col("_id") == F.col("_first._id")), "new")
            .when(F.col("_h") == F.coalesce("payload", F.col("_first._h")), "retry")
            .otherwise("conflict")
            .alias("status"),
        )
        told.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
        latest = copies.agg(F.max("_at")).first()[0]
        keep = None if latest is None else F.col("at") > latest - remember * 1_000_000
        state.write(
            epoch,
            known.filter(fresh).select(*key, F.col("_first._h").alias("payload"), F.col("_first._at").alias("at")),
            keep,
        )

    return write


def stream_counts(
    stream: DataFrame, window: str = "1 hour", delay: str = "10 minutes", by: str | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Event counts per tumbling window, and per ``by`` when given."""
    keys = [F.window(ts, window).alias("w")] + ([F.col(by)] if by else [])
    return (
        stream.withWatermark(ts, delay)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("action") == "block").alias("blocked"),
            F.count_if(F.col("action") == "monitor").alias("monitored"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            *([by] if by else []),
            "total",
            "blocked",
            "monitored",
        )
    )


def throttle_sink(path: str, limit: int = 20, seconds: int = 60, delay: int = 60):
    """``foreachBatch`` writer of the exact sliding throttle: ``path/rows`` holds the decisions.

    A micro-batch is decided by the batch operator, so an account with a third of its attempts
    is many tasks; between micro-batches an account's state is its latest admitted times,
    ``limit`` at most. An attempt that arrives in a later batch is judged against what was
    admitted by then. State is forgotten when nothing that comes at most ``delay`` seconds late
    can meet it any more.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        held = T.StructType(
            [batch.schema["account"], T.StructField("admitted", T.ArrayType(T.LongType())), T.StructField("latest", T.LongType())]
        )
        state = KeyedState(f"{path}/state", held, ["account"])
        rows = batch.select("account", "attempt_id", "ts")
        before = state.newest(spark, epoch).join(rows.select("account").distinct(), "account", "left_semi")
        decided, after = throttle(rows, limit, seconds, before)
        decided.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
        latest = rows.agg(F.max(micros(rows, "ts"))).first()[0]
        told = after.withColumn("latest", F.array_max("admitted"))
        keep = None if latest is None else F.col("latest") > latest - (seconds + delay) * 1_000_000
        state.write(epoch, told, keep)

    return write


def latest_state_sink(path: str):
    """``foreachBatch`` writer that keeps the newest accepted report of each device.

    Each micro-batch is reduced per device and written as a delta (see :class:`KeyedState`),
    with only the devices whose state it changes. :func:`latest_state` reads the result.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        order = F.struct("received_at", "report_id")
        state = KeyedState(path, batch.schema, ["device_id"])
        newest = batch.groupBy("device_id").agg(F.max_by(F.struct(*batch.columns), order).alias("s")).select("s.*")
        held = state.newest(batch.sparkSession, epoch).select("device_id", order.alias("_held"))
        later = newest.join(held, "device_id", "left").filter(F.col("_held").isNull() | (order > F.col("_held")))
        state.write(epoch, later.select(*batch.columns))

    return write


def latest_state(spark: SparkSession, path: str, schema: T.StructType, epochs: int) -> DataFrame:
    """The state that :func:`latest_state_sink` holds after so many micro-batches."""
    return KeyedState(path, schema, ["device_id"]).newest(spark, epochs)


def run_arrivals(
    arrivals: Sequence[DataFrame], start: Callable[[DataFrame, str], DataStreamWriter], folder: str
) -> None:
    """Let frames arrive one after the other, each a micro-batch of a query started anew.

    ``start(stream, folder)`` gives the query's writer. The query stops after each arrival and
    goes on from its checkpoint, so state and progress are read back every time.
    """
    spark, schema = arrivals[0].sparkSession, arrivals[0].schema
    for n, frame in enumerate(arrivals):
        frame.write.mode("overwrite").parquet(f"{folder}/arrived/part={n}")
        stream = spark.readStream.schema(schema).option("basePath", f"{folder}/arrived").parquet(f"{folder}/arrived/part=*")
        writer = start(stream.select(*schema.names), folder).option("checkpointLocation", f"{folder}/progress")
        writer.trigger(availableNow=True).start().awaitTermination()


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4()}"


def collected(stream: DataFrame, folder: str) -> DataStreamWriter:
    """Writer of an append stream into ``folder/rows``."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows")


def run_available(stream: DataFrame) -> DataFrame:
    """Run an append stream over what has arrived, into files, and read the result back.

    The result and its progress go to a new folder beside the checkpoints, so the job can be
    restarted and nothing passes through the driver.
    """
    spark = stream.sparkSession
    folder = new_folder(spark)
    writer = collected(stream, folder).option("checkpointLocation", f"{folder}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
