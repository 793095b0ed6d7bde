import datetime as dt
import random

from pyspark.sql import functions as F

from quietgate.operators import filters, ingest, joins, windows

UUID = "00000000-0000-4000-8000-%012d"
EVENT = (
    "event_id string, timestamp_ms long, policy_revision long, host string, method string, "
    "body_len long, reason string, rules array<string>, action string"
)


def event(n, body_len=1, reason="clean", rules=(), action="allow", host="h.test", method="POST", revision=0):
    return (UUID % n, 1000 + n, revision, host, method, body_len, reason, list(rules), action)


def test_event_valid(spark):
    rows = {
        1: (event(1), None),
        2: (event(2, reason="sensitive_data", rules=["email"], action="monitor"), None),
        3: (event(3, reason="policy_unavailable", action="block"), None),
        4: (event(4, host="h.test/?q"), "event_host_invalid"),
        5: (event(5, method="FETCH"), "event_method_invalid"),
        6: (event(6, body_len=1048577), "event_invalid"),
        7: (event(7, reason="sensitive_data", rules=["email", "email"], action="block"), "event_rules_invalid"),
        8: (event(8, reason="sensitive_data", rules=["nope"], action="block"), "event_rules_invalid"),
        9: (event(9, action="block"), "event_decision_invalid"),
        10: (event(10, reason="sensitive_data", rules=["email"], action="allow"), "event_decision_invalid"),
        11: (event(11, reason="uninspectable_request", rules=["email"], action="block"), "event_decision_invalid"),
        12: (("x",) + event(12)[1:], "event_id_invalid"),
        13: (event(13)[:3] + (None,) + event(13)[4:], "event_incomplete"),
        14: (event(14, host="[::1]:80"), None),
        15: (event(15, reason="other", action="block"), "event_decision_invalid"),
    }
    df = spark.createDataFrame([r for r, _e in rows.values()], EVENT)
    good, bad = filters.event_valid(df)
    assert good.count() + bad.count() == len(rows)
    got = {r.event_id: r.quarantine_reason for r in bad.collect()}
    assert got == {r[0]: e for r, e in rows.values() if e}


def test_idempotent_events(spark):
    keyed = "device_id int, " + EVENT
    batch = spark.createDataFrame(
        [(1, *event(1)), (1, *event(1)), (1, *event(2)), (1, *event(2, body_len=2)), (2, *event(1)), (1, *event(3, body_len=9))],
        keyed,
    )
    stored = spark.createDataFrame([(1, *event(1)), (1, *event(3))], keyed)
    got = {(r.device_id, r.event_id): (r.copies, r.status) for r in ingest.idempotent_events(batch, stored).collect()}
    assert got == {
        (1, UUID % 1): (2, "retry"), (1, UUID % 2): (2, "conflict"),
        (2, UUID % 1): (1, "new"), (1, UUID % 3): (1, "conflict"),
    }


REPORT = (
    "report_id string, device_id int, received_at long, applied_revision long, protection_scope string, "
    f"engine_state string, protected_targets array<string>, events array<struct<{EVENT.replace(' ', ':').replace(',:', ',')}>>"
)


def sequential(reports, live, known, stored=()):
    kept = dict(stored)
    verdict = {}
    for r in sorted(reports, key=lambda r: (r[2], r[0])):
        rid, dev, _at, rev, _s, _e, _t, events = r
        if dev not in live:
            verdict[rid] = "device_unavailable"
            continue
        if any(v > 0 and v not in known for v in [rev, *[e[2] for e in events]]):
            verdict[rid] = "unknown_revision"
            continue
        trial, ok = dict(kept), True
        for e in events:
            ok = ok and trial.setdefault((dev, e[0]), e) == e
        verdict[rid] = None if ok else "event_conflict"
        if ok:
            kept = trial
    return verdict


def test_accept_reports_matches_the_sequential_rule(spark):
    rng = random.Random(3)
    for case in range(3):
        reports = []
        for i in range(60):
            events = [
                event(rng.randint(0, 12), body_len=rng.choice([1, 1, 2]), revision=rng.choice([0, 0, 0, 1, 9]) if case else 0)
                for _ in range(rng.randint(0, 3))
            ]
            reports.append((f"r{i:02d}", rng.randint(1, 4), rng.randint(0, 40), rng.choice([0, 1, 1, 7]) if case == 2 else 1,
                            "fixture", "running", ["h.test"], events))
        devices = spark.createDataFrame(
            [(1, None), (2, None), (3, dt.datetime(2024, 1, 1))], "device_id int, revoked_at timestamp"
        )
        policies = spark.createDataFrame([(1,), (2,)], "revision long")
        df = spark.createDataFrame(reports, REPORT)
        old = [(1, *event(0, body_len=2))]
        stored = spark.createDataFrame(old, "device_id int, " + EVENT) if case == 2 else None
        known = {(d[0], d[1]): tuple(d[1:]) for d in old} if case == 2 else {}
        out = ingest.accept_reports(df, devices, policies, stored).collect()
        got = {r.report_id: r.reject_reason for r in out}
        assert got == sequential(reports, {1, 2}, {1, 2}, known)
        assert len(out) == len(reports)


def test_report_shape(spark):
    ok = ("a", 1, 1, 0, "fixture", "running", ["h.test"], [])
    bad = [
        ("b", 1, 1, -1, *ok[4:]), ("c", 1, 1, 0, "other", *ok[5:]), ("d", 1, 1, 0, "fixture", "on", *ok[6:]),
        ("e", 1, 1, 0, "fixture", "running", ["h.test"] * 33, []), ("f", 1, 1, 0, "fixture", "running", ["h/x"], []),
        ("g", 1, 1, 0, "fixture", "running", [], [event(i) for i in range(101)]),
        ("h", 1, 1, 0, "fixture", "running", [], [event(1, action="block")]),
    ]
    devices = spark.createDataFrame([(1, None)], "device_id int, revoked_at timestamp")
    policies = spark.createDataFrame([(1,)], "revision long")
    out = ingest.accept_reports(spark.createDataFrame([ok, *bad], REPORT), devices, policies)
    got = {r.report_id: r.reject_reason for r in out.collect()}
    assert got == {
        "a": None, "b": "report_revision_invalid", "c": "report_scope_invalid", "d": "report_state_invalid",
        "e": "report_targets_invalid", "f": "report_targets_invalid", "g": "report_events_invalid", "h": "event_invalid",
    }
    assert ingest.device_latest(out).first().last_seen == 1
    assert ingest.accepted_ids(out).first().accepted_event_ids == []


def test_queue_capacity_matches_the_sequential_rule(spark):
    rng = random.Random(9)
    rows = [(d, f"{d}-{i}", i * rng.choice([1, 1, 3]) + i, rng.randint(1, 400)) for d in range(5) for i in range(80)]
    df = spark.createDataFrame(rows, "device_id int, event_id string, seq long, bytes long")
    got = {r.event_id: r.accepted for r in windows.queue_capacity(df, 20, 5000, chunk=7).collect()}
    expect = {}
    for d in range(5):
        n = b = 0
        for _d, eid, _s, size in sorted((r for r in rows if r[0] == d), key=lambda r: r[2]):
            expect[eid] = n < 20 and b + size <= 5000
            n, b = n + expect[eid], b + size * expect[eid]
    assert got == expect and set(expect.values()) == {True, False}


def test_queue_rounds_are_few_and_split_a_device(spark):
    """A flood of rows of all sizes after the overflow: still the sequential rule."""
    rng = random.Random(10)
    sizes = [rng.choice([1, 2, 3, 50, 400, 2900, 7000]) for _ in range(3000)]
    df = spark.createDataFrame([(1, f"e{i}", i, x) for i, x in enumerate(sizes)], "device_id int, event_id string, seq long, bytes long")
    for most, room in ((10**6, 20000), (120, 20000), (3, 10**9), (0, 100), (10**6, 0)):
        out = windows.queue_capacity(df, most, room, chunk=100)
        got = {r.seq: r.accepted for r in out.collect()}
        n = b = 0
        for i, x in enumerate(sizes):
            fits = n < most and b + x <= room
            assert got[i] == fits, (most, room, i)
            n, b = n + fits, b + x * fits


def test_throttle_of_a_flood_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(windows, "CHUNK_WINDOWS", 3)
    base = dt.datetime(2024, 1, 1)
    rng = random.Random(5)
    times = sorted(rng.randrange(0, 6000) for _ in range(4000)) + [9000, 9001]
    df = spark.createDataFrame([("x", i, base + dt.timedelta(seconds=t)) for i, t in enumerate(times)], "account string, attempt_id int, ts timestamp")
    out = windows.attempt_throttle(df, 5, 60)
    spread = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < len(times)
    got, admitted = {r.attempt_id: r.admitted for r in out.collect()}, []
    for i, t in enumerate(times):
        ok = sum(t - x < 60 for x in admitted) < 5
        admitted += [t] * ok
        assert got[i] == ok


def test_throttle_matches_the_sequential_rule(spark):
    rng = random.Random(4)
    base = dt.datetime(2024, 1, 1)
    rows = [(a, i, base + dt.timedelta(seconds=t)) for a in "xy" for i, t in enumerate(sorted(rng.sample(range(0, 4000), 400)))]
    df = spark.createDataFrame(rows, "account string, attempt_id int, ts timestamp")
    got = {(r.account, r.attempt_id): r.admitted for r in windows.attempt_throttle(df, 4, 60).collect()}
    for a in "xy":
        admitted = []
        for _a, i, t in (r for r in rows if r[0] == a):
            ok = sum((t - x).total_seconds() < 60 for x in admitted) < 4
            admitted += [t] * ok
            assert got[a, i] == ok
    estimate = windows.throttle_estimate(df, 4, 60)
    assert estimate.filter(~F.col("over_limit")).count() <= sum(got.values())


def test_audit_check(spark):
    rows = [("l", i, 10) for i in (1, 2, 4, 5, 6)] + [("m", 1, 35), ("m", 2, 10), ("m", 3, 1)]
    df = spark.createDataFrame(rows, "log_id string, event_id long, bytes long")
    got = {(r.log_id, r.event_id): r.problem for r in ingest.audit_check(df, 40, chunk=2).collect()}
    full = "audit_capacity_exhausted"
    assert got == {
        ("l", 1): None, ("l", 2): None, ("l", 4): "sequence_gap", ("l", 5): None, ("l", 6): full,
        ("m", 1): None, ("m", 2): full, ("m", 3): full,
    }


def test_outbox_and_acks(spark):
    queue = spark.createDataFrame([(1, f"e{i}", i, 10) for i in range(6)], "device_id int, event_id string, seq long, bytes long")
    acks = spark.createDataFrame([(1, "e0"), (1, "e9"), (2, "e1")], "device_id int, event_id string")  # e1's is another device's
    got = {r.event_id: (r.status, r.batch) for r in ingest.outbox_status(queue, acks, 4, 1000, 2).collect()}
    assert got == {
        "e0": ("acknowledged", None), "e1": ("waiting", 0), "e2": ("waiting", 0), "e3": ("waiting", 1),
        "e4": ("outbox_full", None), "e5": ("outbox_full", None),
    }
    assert sorted(r.event_id for r in joins.foreign_acks(queue, acks).collect()) == ["e1", "e9"]


def test_engine_state(spark):
    reports = spark.createDataFrame(
        [("a", 1, "running"), ("b", 2, "running"), ("c", 9, "running"), ("d", 9, "stopped")],
        "id string, applied_revision long, engine_state string",
    )
    policies = spark.createDataFrame([(1, 100), (2, 50)], "revision long, expires_at long")
    got = {r.id: r.effective_state for r in ingest.engine_state(reports, policies, 50).collect()}
    assert got == {"a": "running", "b": "policy_unavailable", "c": "policy_unavailable", "d": "stopped"}


def test_lists_of_a_busy_device_stay_bounded(spark):
    from quietgate.plans.derived import frame
    from quietgate.plans.ingest_queries import report_frame

    one = frame(spark, "/root/testdata/sf0.001", "report_rows").limit(1)
    busy = one.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4999))))
    rows = busy.withColumn("event_id", F.concat("event_id", F.lit("-"), "k")).drop("k")
    sizes = [r.n for r in report_frame(rows).select(F.size("events").alias("n")).collect()]
    assert sizes == [ingest.REPORT_EVENTS + 1]
    few = report_frame(rows.limit(100)).select(F.size("events").alias("n")).collect()
    assert [r.n for r in few] == [100]
