import datetime as dt

import pytest
from pyspark.sql import functions as F

from quietgate.operators import scan, windows
from quietgate.plans.derived import frame
from quietgate.plans.report_queries import rule_array
from quietgate.streaming import streams
from quietgate.streaming.keyed import KeyedState

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture()
def source(spark, tmp_path):
    """Write a batch frame as files and hand it back as a stream."""

    def start(df, files=4, max_files=None):
        path = str(tmp_path / "in")
        df.repartition(files).write.parquet(path)
        return streams.read_stream(spark, path, df.schema, max_files)

    return start


def drain(spark, df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def test_stream_scan_equals_batch(spark, source):
    docs = frame(spark, FOLDER, "planted").select("doc_id", "text")
    out = drain(spark, streams.stream_scan(source(docs, max_files=1), ["doc_id"]), "scan")
    assert out.columns == ["doc_id", "findings", "severity"]
    got = {r.doc_id: (sorted(f.rule for f in r.findings), r.severity) for r in out.collect()}
    batch = scan.severity(scan.findings(docs)).collect()
    assert got == {r.doc_id: (sorted(f.rule for f in r.findings), r.severity) for r in batch}


def test_stream_inspect_decides_with_policies(spark, source):
    rows = [("a", "h", "POST", "/", "text/plain", bytearray(b"x@y.kr"), 150), ("b", "h", "POST", "/", "text/plain", bytearray(b"hi"), 150)]
    df = spark.createDataFrame(rows, "id string, host string, method string, path string, content_type string, body binary, ts_s long")
    policies = spark.createDataFrame([(4, {"email": "monitor"}, 100, 200)], "revision long, rules map<string,string>, issued_at long, expires_at long")
    out = drain(spark, streams.stream_inspect(source(df), policies), "inspect")
    assert not {"body", "path"} & set(out.columns)
    assert {r.id: r.effective_action for r in out.collect()} == {"a": "monitor", "b": "allow"}


def managed(spark):
    return rule_array(frame(spark, FOLDER, "resent")).withColumn("ts", F.col("received_at").cast("timestamp"))


def test_stream_dedup_keeps_one_copy(spark, source):
    df = managed(spark)
    out = drain(spark, streams.stream_dedup(source(df), "60 days").select("device_id", "event_id"), "dedup")
    assert out.count() == out.distinct().count() == df.select("device_id", "event_id").distinct().count()


def sunk(spark, folder, arrivals, sink):
    streams.run_arrivals(arrivals, lambda stream, at: stream.writeStream.foreachBatch(sink(at)), folder)
    return spark.read.parquet(f"{folder}/rows").drop("epoch").collect()


def test_conflicts_over_ten_micro_batches(spark, tmp_path):
    fields = "device_id int, event_id string, ts timestamp, action string, body_len long, host string, method string, policy_revision long, reason string, rules array<string>, timestamp_ms long"
    base = dt.datetime(2024, 1, 1)

    def copy(event, size, hours):
        return (1, event, base + dt.timedelta(hours=hours), "allow", size, "h", "GET", 0, "clean", [], 0)

    parts = [[copy(f"e{k}", 1, k), copy(f"e{k}", 2, k + 0.5), copy(f"e{k}", 1, k + 0.7)] for k in range(10)]
    parts[3] += [copy("e2", 1, 2.2), copy("e2", 7, 2.3)]  # late, still known
    parts[9] += [copy("e0", 5, 0)]  # forgotten by then: it counts as new
    arrivals = [spark.createDataFrame(p, fields) for p in parts]
    folder = str(tmp_path / "run")
    rows = sunk(spark, folder, arrivals, lambda at: streams.conflict_sink(at, 3 * 3600, compact=4))
    got = {}
    for r in rows:
        got.setdefault(r.event_id, []).append(r.status)
    assert sorted(got["e2"]) == ["conflict", "conflict", "new", "retry", "retry"]
    assert sorted(got["e0"]) == ["conflict", "new", "new", "retry"]
    assert all(sorted(got[f"e{k}"]) == ["conflict", "new", "retry"] for k in (1, 3, 4, 5, 6, 7, 8, 9))
    # State falls: the whole written after eight batches holds the last three hours alone.
    assert spark.read.parquet(f"{folder}/state/whole=8").count() <= 4


def test_a_micro_batch_may_be_written_again(spark, tmp_path):
    write = streams.throttle_sink(str(tmp_path), 2, 60)
    base = dt.datetime(2024, 1, 1)
    batches = [spark.createDataFrame([("a", 10 * k + i, base + dt.timedelta(seconds=20 * k + i)) for i in range(3)],
                                     "account string, attempt_id int, ts timestamp") for k in range(4)]
    for epoch, batch in enumerate(batches):
        write(batch, epoch)
        write(batch, epoch)
    rows = spark.read.parquet(str(tmp_path / "rows")).collect()
    assert {r.attempt_id for r in rows if r.admitted} == {0, 1, 30, 31}
    assert len(rows) == 12


def test_policies_published_while_the_stream_runs(spark, tmp_path):
    rows = [("a", "h", "POST", "/", "text/plain", bytearray(b"x@y.kr"), 150), ("b", "h", "POST", "/", "text/plain", bytearray(b"hi"), 150)]
    fields = "id string, host string, method string, path string, content_type string, body binary, ts_s long"
    policies = spark.createDataFrame([(4, {"email": "block"}, 100, 900), (5, {"email": "monitor"}, 120, 900)],
                                     "revision long, rules map<string,string>, issued_at long, expires_at long")
    arrivals = [spark.createDataFrame([(f"{r[0]}{k}", *r[1:]) for r in rows], fields) for k in range(3)]
    known = [policies.limit(0), policies.filter("revision = 4"), policies]
    folder = str(tmp_path / "run")
    streams.run_arrivals(
        arrivals, lambda s, at: streams.stream_inspect(s).writeStream.foreachBatch(
            streams.decision_sink(f"{at}/rows", lambda _spark, epoch: known[epoch])), folder,
    )
    got = {r.id: (r.effective_revision, r.effective_action) for r in spark.read.parquet(f"{folder}/rows").collect()}
    assert got == {"a0": (0, "block"), "b0": (0, "block"), "a1": (4, "block"), "b1": (4, "allow"), "a2": (5, "monitor"), "b2": (5, "allow")}


def test_stream_counts_equal_batch(spark, source):
    df = managed(spark).select("ts", "action", "method")
    out = drain(spark, streams.stream_counts(source(df), "1 day", "1 hour", "method"), "counts", "complete")
    batch = df.groupBy(F.window("ts", "1 day").start.alias("window_start"), "method").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("action") == "block").alias("blocked"),
        F.count_if(F.col("action") == "monitor").alias("monitored"),
    )
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("parts", [1, 5])
def test_stream_throttle_equals_batch(spark, tmp_path, parts):
    base = dt.datetime(2024, 1, 1)
    rows = [(a, i, base + dt.timedelta(seconds=i * 7)) for a in "xy" for i in range(100)]
    df = spark.createDataFrame(rows, "account string, attempt_id int, ts timestamp")
    arrivals = [df.filter(F.floor(F.col("attempt_id") * parts / 100) == k) for k in range(parts)]
    out = sunk(spark, str(tmp_path / "run"), arrivals, lambda at: streams.throttle_sink(at, 3, 60))
    batch = windows.attempt_throttle(df, 3, 60)
    assert sorted(map(tuple, out)) == sorted(map(tuple, batch.collect()))


def test_latest_state_keeps_newest_and_writes_what_changed(spark, tmp_path):
    schema = "device_id int, report_id string, received_at long, engine_state string"
    path = str(tmp_path / "state")
    write = streams.latest_state_sink(path)
    write(spark.createDataFrame([(i, "a", 5, "running") for i in range(100)], schema), 0)
    write(spark.createDataFrame([(1, "c", 4, "stopped"), (2, "d", 9, "stopped")], schema), 1)
    rows = streams.latest_state(spark, path, spark.createDataFrame([], schema).schema, 2).collect()
    assert len(rows) == 100 and {r.device_id: r.report_id for r in rows if r.device_id < 4} == {0: "a", 1: "a", 2: "d", 3: "a"}
    assert spark.read.parquet(f"{path}/delta=1").count() == 1
    for epoch in range(2, 18):
        write(spark.createDataFrame([(epoch, "z", 20, "running")], schema), epoch)
    rows = streams.latest_state(spark, path, spark.createDataFrame([], schema).schema, 18).collect()
    assert len(rows) == 100 and sum(r.report_id == "z" for r in rows) == 16
    assert spark.read.parquet(f"{path}/whole=16").count() == 100


def test_keyed_state_is_not_sent_through_the_driver(spark, tmp_path, capsys):
    rows = spark.range(10).select(F.col("id").alias("device_id"), F.lit("x").alias("payload"))
    state = KeyedState(str(tmp_path / "state"), rows.schema, ["device_id"])
    state.write(0, rows)
    joined = spark.range(3).withColumnRenamed("id", "device_id").join(state.newest(spark, 1), "device_id", "left")
    joined.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out
    assert sorted(joined.collect()) == [(k, "x") for k in range(3)]
