"""Ingest queries: idempotence, reports, queues, audit and throttling."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.clock import instant
from ..operators import ingest, joins, windows
from .catalog import Catalog
from .policy_queries import with_maps
from .report_queries import rule_array

CATALOG = Catalog()

MID_MONTH = dt.datetime(2024, 1, 16)


@CATALOG.add(
    "resent", "managed",
    sql="""WITH b AS (SELECT device_id, event_id, count(*) AS copies, min(body_len) AS lo, max(body_len) AS hi FROM resent GROUP BY ALL)
    SELECT b.device_id, b.event_id, copies, CASE WHEN lo <> hi OR (m.event_id IS NOT NULL AND m.body_len <> lo) THEN 'conflict'
      WHEN m.event_id IS NOT NULL THEN 'retry' ELSE 'new' END AS status
    FROM b LEFT JOIN (SELECT * FROM managed WHERE received_at < TIMESTAMP '2024-01-16') m ON m.device_id = b.device_id AND m.event_id = b.event_id""",
)
def idempotent_events(batch, events):
    """A resent batch against what had been stored by mid-month."""
    stored = events.filter(F.col("received_at") < instant(events, "received_at", MID_MONTH))
    return ingest.idempotent_events(rule_array(batch), rule_array(stored))


def report_frame(rows):
    """Nested reports. A report is a device's day, and the contract allows 100 events in it.

    A report with more is refused whole, so one event beyond the limit says as much as all of
    them: no list is longer than that, however busy the device.
    """
    day = Window.partitionBy("report_id", "device_id", "received_at", "day").orderBy("event_id")
    rows = rows.withColumn("_n", F.row_number().over(day)).filter(F.col("_n") <= ingest.REPORT_EVENTS + 1).drop("_n")
    event = F.struct(
        "event_id", "timestamp_ms", "policy_revision", "host", "method", "body_len", "reason",
        "rules", "action",
    )
    return rule_array(rows).groupBy("report_id", "device_id", "received_at", "day").agg(
        F.sort_array(F.collect_list(event)).alias("events")
    ).select(
        "report_id",
        "device_id",
        "received_at",
        F.when(F.col("day") % 7 == 3, F.lit(2)).otherwise(F.lit(0)).cast("long").alias("applied_revision"),
        F.when(F.col("day") % 9 == 8, F.lit("everything"))
        .otherwise(F.lit("configured_applications"))
        .alias("protection_scope"),
        F.when(F.col("day") % 2 == 0, "running").otherwise("starting").alias("engine_state"),
        F.array(F.concat(F.lit("t"), F.col("device_id").cast("string"))).alias("protected_targets"),
        "events",
    )


def device_frame(devices):
    return devices.select(F.col("id").alias("device_id"), "revoked_at")


_REPORTS = """SELECT report_id, device_id, received_at, day, list({'k': event_id, 'h': body_len}) AS ev,
      bool_or(policy_revision > 0 AND policy_revision NOT IN (SELECT revision FROM policies)) AS unknown, count(*) AS n_events
    FROM report_rows GROUP BY ALL"""
_ALONE = f"""SELECT r.*, CASE WHEN d.id IS NULL OR d.revoked_at IS NOT NULL THEN 'device_unavailable'
      WHEN day % 9 = 8 THEN 'report_scope_invalid' WHEN n_events > 100 THEN 'report_events_invalid'
      WHEN day % 7 = 3 OR unknown THEN 'unknown_revision' END AS alone
    FROM ({_REPORTS}) r LEFT JOIN devices d ON d.id = r.device_id"""
_ACCEPT = f"""WITH RECURSIVE reports AS MATERIALIZED ({_ALONE}),
    good AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY received_at, report_id) AS rn FROM reports WHERE alone IS NULL),
    walk AS (
      SELECT device_id, cast(0 as bigint) AS rn, '' AS report_id, false AS clash, [{{'k': '', 'h': cast(0 as bigint)}}] AS stored FROM good WHERE rn = 1
      UNION ALL
      SELECT g.device_id, g.rn, g.report_id, c.clash, CASE WHEN c.clash THEN w.stored ELSE list_concat(w.stored, g.ev) END
      FROM walk w JOIN good g ON g.device_id = w.device_id AND g.rn = w.rn + 1,
        LATERAL (SELECT len(list_filter(w.stored, lambda s: len(list_filter(g.ev, lambda e: e.k = s.k AND e.h <> s.h)) > 0)) > 0 AS clash) c),
    verdict AS (SELECT r.report_id, r.device_id, r.received_at, r.day, r.n_events, coalesce(r.alone, CASE WHEN w.clash THEN 'event_conflict' END) AS reject_reason
      FROM reports r LEFT JOIN walk w ON w.report_id = r.report_id)
    """


@CATALOG.add(
    "report_rows", "devices", "policies",
    sql=_ACCEPT + "SELECT report_id, reject_reason, reject_reason IS NULL AS accepted FROM verdict",
)
def report_atomicity(rows, devices, policies):
    judged = ingest.accept_reports(report_frame(rows), device_frame(devices), policies)
    return judged.select("report_id", "reject_reason", "accepted")


@CATALOG.add(
    "report_rows", "devices", "policies",
    sql=_ACCEPT + "SELECT report_id, n_events FROM verdict WHERE reject_reason IS NULL",
)
def accepted_ids(rows, devices, policies):
    judged = ingest.accept_reports(report_frame(rows), device_frame(devices), policies)
    return ingest.accepted_ids(judged).select(
        "report_id", F.size("accepted_event_ids").cast("long").alias("n_events")
    )


@CATALOG.add(
    "report_rows", "devices", "policies",
    sql=_ACCEPT + """SELECT device_id, max(received_at) AS last_seen, cast(CASE WHEN arg_max(day, received_at) % 7 = 3 THEN 2 ELSE 0 END as bigint) AS applied_revision,
      CASE WHEN arg_max(day, received_at) % 2 = 0 THEN 'running' ELSE 'starting' END AS engine_state
    FROM verdict WHERE reject_reason IS NULL GROUP BY device_id""",
)
def device_latest(rows, devices, policies):
    judged = ingest.accept_reports(report_frame(rows), device_frame(devices), policies)
    return ingest.device_latest(judged).select(
        "device_id", "last_seen", "applied_revision", "engine_state"
    )


@CATALOG.add(
    "report_rows", "devices",
    sql="""SELECT DISTINCT report_id FROM report_rows r WHERE NOT EXISTS
      (SELECT 1 FROM devices d WHERE d.id = r.device_id AND d.revoked_at IS NULL)""",
)
def revoked_filter(rows, devices):
    return joins.revoked_filter(report_frame(rows), devices).select("report_id")


@CATALOG.add(
    "report_rows", "policies", "policy_rules",
    sql="""SELECT DISTINCT report_id, CASE WHEN day % 2 = 1 THEN 'starting'
      WHEN (SELECT max(expires_at) FROM policies WHERE revision = 5 + r.day) > 1000000 THEN 'running'
      ELSE 'policy_unavailable' END AS effective_state FROM report_rows r""",
)
def engine_state(rows, policies, policy_rules):
    days = rows.select("report_id", (F.col("day") + 5).alias("applied_revision")).distinct()
    reports = report_frame(rows).drop("applied_revision").join(days, "report_id")
    state = ingest.engine_state(reports, with_maps(policies, policy_rules), 1000000)
    return state.select("report_id", "effective_state")


MAX_N, MAX_BYTES, UPLOAD = 40, 24000, 10
_FOLD = f"""WITH RECURSIVE q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY seq) AS rn FROM queue),
    walk AS (
      SELECT device_id, cast(0 as bigint) AS rn, '' AS event_id, cast(0 as bigint) AS seq, false AS accepted, cast(0 as bigint) AS n, cast(0 as bigint) AS b
      FROM q WHERE rn = 1
      UNION ALL
      SELECT q.device_id, q.rn, q.event_id, q.seq, w.n < {MAX_N} AND w.b + q.bytes <= {MAX_BYTES},
        w.n + CASE WHEN w.n < {MAX_N} AND w.b + q.bytes <= {MAX_BYTES} THEN 1 ELSE 0 END,
        w.b + CASE WHEN w.n < {MAX_N} AND w.b + q.bytes <= {MAX_BYTES} THEN q.bytes ELSE 0 END
      FROM walk w JOIN q ON q.device_id = w.device_id AND q.rn = w.rn + 1)
    """


@CATALOG.add(
    "queue",
    sql=_FOLD + "SELECT device_id, event_id, accepted FROM walk WHERE rn > 0",
)
def queue_capacity(queue):
    return windows.queue_capacity(queue, MAX_N, MAX_BYTES).select(
        "device_id", "event_id", "accepted"
    )


@CATALOG.add(
    "queue",
    sql="""SELECT device_id, event_id, cast(floor((row_number() OVER (PARTITION BY device_id ORDER BY seq) - 1) / 10.0) as bigint) AS batch FROM queue""",
)
def batches(queue):
    return windows.batches(queue, UPLOAD).select("device_id", "event_id", "batch")


@CATALOG.add(
    "queue", "acks",
    sql="SELECT event_id, bytes FROM queue q WHERE NOT EXISTS (FROM acks a WHERE a.device_id = q.device_id AND a.event_id = q.event_id)",
)
def ack_anti(queue, acks):
    return joins.ack_anti(queue, acks).select("event_id", "bytes")


@CATALOG.add(
    "queue", "resent",
    sql="SELECT device_id, event_id FROM resent r WHERE NOT EXISTS (FROM queue q WHERE q.device_id = r.device_id AND q.event_id = r.event_id)",
)
def foreign_acks(queue, resent):
    return joins.foreign_acks(queue, resent)


@CATALOG.add(
    "queue", "acks",
    sql=_FOLD
    + f""", kept AS (SELECT w.*, EXISTS (FROM acks a WHERE a.device_id = w.device_id AND a.event_id = w.event_id) AS acked FROM walk w WHERE rn > 0),
    waiting AS (SELECT device_id, event_id, cast(floor((row_number() OVER (PARTITION BY device_id ORDER BY seq) - 1) / {UPLOAD}.0) as bigint) AS batch
      FROM kept WHERE accepted AND NOT acked)
    SELECT k.device_id, k.event_id, w.batch, CASE WHEN NOT accepted THEN 'outbox_full' WHEN w.batch IS NULL THEN 'acknowledged' ELSE 'waiting' END AS status
    FROM kept k LEFT JOIN waiting w ON w.device_id = k.device_id AND w.event_id = k.event_id""",
)
def outbox_status(queue, acks):
    return ingest.outbox_status(queue, acks, MAX_N, MAX_BYTES, UPLOAD).select(
        "device_id", "event_id", "batch", "status"
    )


@CATALOG.add(
    "audit_log",
    sql="""SELECT log_id, event_id, CASE WHEN sum(bytes) OVER w > 30000 THEN 'audit_capacity_exhausted'
      WHEN event_id <> coalesce(lag(event_id) OVER (PARTITION BY log_id ORDER BY event_id), 0) + 1 THEN 'sequence_gap' END AS problem
    FROM audit_log WINDOW w AS (PARTITION BY log_id ORDER BY event_id)""",
)
def audit_check(log):
    return ingest.audit_check(log, 30000).select("log_id", "event_id", "problem")


THROTTLE_SQL = """WITH RECURSIVE a AS MATERIALIZED (SELECT account, attempt_id, epoch_us(ts) AS t,
        row_number() OVER (PARTITION BY account ORDER BY ts, attempt_id) AS rn FROM attempts),
    walk AS (
      SELECT account, cast(0 as bigint) AS rn, cast(-1 as bigint) AS attempt_id, false AS admitted, cast([] as bigint[]) AS seen FROM a WHERE rn = 1
      UNION ALL
      SELECT a.account, a.rn, a.attempt_id, len(list_filter(w.seen, lambda s: a.t - s < 3600000000)) < 3,
        CASE WHEN len(list_filter(w.seen, lambda s: a.t - s < 3600000000)) < 3
          THEN list_append(list_filter(w.seen, lambda s: a.t - s < 3600000000), a.t)
          ELSE list_filter(w.seen, lambda s: a.t - s < 3600000000) END
      FROM walk w JOIN a ON a.account = w.account AND a.rn = w.rn + 1)
    SELECT account, attempt_id, admitted FROM walk WHERE rn > 0"""


@CATALOG.add("attempts", sql=THROTTLE_SQL)
def attempt_throttle(attempts):
    return windows.attempt_throttle(attempts, 3, 3600)


@CATALOG.add(
    "attempts",
    sql="""SELECT account, attempt_id, count(*) OVER (PARTITION BY account ORDER BY epoch_us(ts)
      RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) > 3 AS over_limit FROM attempts""",
)
def throttle_estimate(attempts):
    return windows.throttle_estimate(attempts, 3, 3600).select("account", "attempt_id", "over_limit")
