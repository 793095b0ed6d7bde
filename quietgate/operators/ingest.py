"""Event ingest: validation, idempotence, report atomicity, device state and audit checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.running import running
from .filters import MAX_SAFE_INTEGER, event_reject_reason, event_valid
from .joins import ack_anti, foreign_acks
from .windows import batches, queue_capacity

EVENT_FIELDS = [
    "action", "body_len", "event_id", "host", "method", "policy_revision", "reason", "rules",
    "timestamp_ms",
]
# Domains of a device report.
SCOPES = ["fixture", "selected_process", "configured_applications"]
ENGINE_STATES = ["starting", "running", "stopped", "policy_unavailable"]

# Fixed value: how many events a report may hold.
REPORT_EVENTS = 100


def ingest_split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validated events, and the rest with the reason each was set aside."""
    return event_valid(events)


def ingest_summary(events: DataFrame) -> DataFrame:
    """Rows per outcome: ``accepted`` or the quarantine reason."""
    outcome = F.coalesce(event_reject_reason(), F.lit("accepted"))
    return events.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))


def payload_hash(fields: list[str] = EVENT_FIELDS, prefix: str = "") -> Column:
    """Content hash of an event over its fields in alphabetical order; rule order counts."""
    return F.sha2(
        F.to_json(F.struct(*[F.col(f"{prefix}{f}").alias(f) for f in sorted(fields)])), 256
    )


def idempotent_events(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row per (device, event): new, retry of the same payload, or conflict.

    Both keys and hashes are aggregated (min and max of the hash tell whether copies differ), so
    a heavily retried event reaches the shuffle once per task. Against ``stored`` the key is a
    primary key kept for ever.
    """
    seen = batch.select("device_id", "event_id", payload_hash().alias("_h"))
    keys = seen.groupBy("device_id", "event_id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("_h").alias("_lo"),
        F.max("_h").alias("_hi"),
    )
    if stored is None:
        known = keys.withColumn("_s", F.lit(None).cast("string"))
    else:
        old = stored.select("device_id", "event_id", payload_hash().alias("_s"))
        known = keys.join(old, ["device_id", "event_id"], "left")
    conflict = (F.col("_lo") != F.col("_hi")) | (
        F.col("_s").isNotNull() & (F.col("_s") != F.col("_lo"))
    )
    return known.select(
        "device_id",
        "event_id",
        "copies",
        F.when(conflict, "conflict")
        .when(F.col("_s").isNotNull(), "retry")
        .otherwise("new")
        .alias("status"),
    )


def report_flat(reports: DataFrame) -> DataFrame:
    """One row per report and event; reports without events keep one row with a NULL event."""
    return reports.select(
        "report_id", "device_id", "received_at", "applied_revision",
        F.explode_outer("events").alias("event"),
    )


def report_problem() -> Column:
    """Shape problems of a report by itself."""
    safe = F.col("applied_revision").between(0, MAX_SAFE_INTEGER)
    host_ok = F.forall(
        "protected_targets", lambda h: h.rlike(r"\A[A-Za-z0-9.:\[\]-]{1,253}\z")
    )
    return (
        F.when(~safe, "report_revision_invalid")
        .when(~F.col("protection_scope").isin(*SCOPES), "report_scope_invalid")
        .when(~F.col("engine_state").isin(*ENGINE_STATES), "report_state_invalid")
        .when((F.size("protected_targets") > 32) | ~host_ok, "report_targets_invalid")
        .when(F.size("events") > REPORT_EVENTS, "report_events_invalid")
    )


def _conflicting_reports(events: DataFrame) -> DataFrame:
    """Reports that contradict an earlier accepted report, or themselves.

    Whether a report counts depends on the fate of earlier ones, so reports that share a
    contested event are settled in rounds: accept those with no earlier undecided rival, reject
    those that contradict an accepted one. Uncontested events, nearly all, never enter a round.
    """
    key = ["device_id", "event_id"]
    contested = (
        events.groupBy(*key)
        .agg(F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
        .filter(F.col("_lo") != F.col("_hi"))
        .select(*key)
    )
    copies = cut(
        events.join(contested, key, "left_semi")
        .groupBy(*key, "report_id", "received_at")
        .agg(F.min("_h").alias("_h"), F.max("_h").alias("_hi"))
        .withColumn("_at", F.struct("received_at", "report_id"))
    )
    torn = copies.filter(F.col("_h") != F.col("_hi")).select("report_id").distinct()
    open_ = copies.join(torn, "report_id", "left_anti").drop("_hi")
    rejected = torn
    while not open_.isEmpty():
        lead = open_.groupBy(*key).agg(
            F.min("_at").alias("_lead"), F.min_by("_h", "_at").alias("_lead_h")
        )
        led = open_.join(lead, key)
        rival = (
            led.filter(F.col("_h") != F.col("_lead_h"))
            .groupBy(*key)
            .agg(F.min("_at").alias("_rival"))
        )
        waiting = (
            led.join(rival, key, "left")
            .filter((F.col("_h") != F.col("_lead_h")) | (F.col("_rival") < F.col("_at")))
            .select("report_id")
            .distinct()
            .withColumn("_waits", F.lit(True))
        )
        marked = open_.join(waiting, "report_id", "left")
        stored = (
            marked.filter(F.col("_waits").isNull()).groupBy(*key).agg(F.min("_h").alias("_s"))
        )
        beaten = (
            marked.filter("_waits")
            .join(stored, key)
            .filter(F.col("_h") != F.col("_s"))
            .select("report_id")
            .distinct()
            .withColumn("_beaten", F.lit(True))
        )
        judged = cut(marked.join(beaten, "report_id", "left"))
        rejected = rejected.union(judged.filter("_beaten").select("report_id"))
        open_ = judged.filter("_waits and _beaten is null").drop("_waits", "_beaten")
    return rejected.distinct()


def accept_reports(
    reports: DataFrame,
    devices: DataFrame,
    policies: DataFrame,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Add ``accepted`` and ``reject_reason`` per report: one bad part rejects all of it.

    A report is read in arrival order against what accepted reports stored before it, so an
    event's first accepted payload is the one retries are compared with. Rejected reports, for
    whatever reason, store nothing. ``stored`` holds events accepted by earlier runs.
    """
    live = devices.filter(F.col("revoked_at").isNull()).select("device_id", F.lit(True).alias("_live"))
    known = policies.select(F.col("revision").alias("_rev"), F.lit(True).alias("_known"))
    shaped = reports.withColumn("_shape", report_problem())
    flat = report_flat(shaped).select("report_id", "device_id", "received_at", "applied_revision", "event.*")
    used = (
        flat.select(
            "report_id", F.explode(F.array("applied_revision", "policy_revision")).alias("_rev")
        )
        .filter(F.col("_rev") > 0)
        .distinct()
        .join(known, "_rev", "left_anti")
        .select("report_id")
        .distinct()
        .withColumn("_unknown", F.lit(True))
    )
    bad_event = (
        flat.filter(F.col("event_id").isNotNull() & event_reject_reason().isNotNull())
        .select("report_id")
        .distinct()
        .withColumn("_bad_event", F.lit(True))
    )
    alone = cut(
        shaped.join(live, "device_id", "left")
        .join(used, "report_id", "left")
        .join(bad_event, "report_id", "left")
        .withColumn(
            "_alone",
            F.coalesce(
                F.when(F.col("_live").isNull(), "device_unavailable"),
                F.col("_shape"),
                F.when(F.col("_bad_event"), "event_invalid"),
                F.when(F.col("_unknown"), "unknown_revision"),
            ),
        )
        .select("report_id", "_alone")
    )
    hashed = cut(
        flat.filter(F.col("event_id").isNotNull())
        .withColumn("_h", payload_hash())
        .join(alone.filter(F.col("_alone").isNull()).select("report_id"), "report_id", "left_semi")
        .select("report_id", "device_id", "event_id", "received_at", "_h")
    )
    if stored is None:
        clash = _conflicting_reports(hashed)
    else:
        old = stored.select("device_id", "event_id", payload_hash().alias("_s"))
        against = (
            hashed.join(old, ["device_id", "event_id"])
            .filter(F.col("_h") != F.col("_s"))
            .select("report_id")
            .distinct()
        )
        rest = hashed.join(against, "report_id", "left_anti")
        clash = _conflicting_reports(rest).unionByName(against).distinct()
    clash = clash.withColumn("_clash", F.lit(True))
    return reports.join(alone, "report_id").join(clash, "report_id", "left").select(
        *reports.columns,
        F.coalesce(
            F.col("_alone"), F.when(F.col("_clash"), "event_conflict")
        ).alias("reject_reason"),
    ).withColumn("accepted", F.col("reject_reason").isNull())


def device_latest(reports: DataFrame) -> DataFrame:
    """State of each device from its newest accepted report."""
    state = F.struct(
        F.col("received_at").alias("last_seen"),
        "applied_revision",
        "protection_scope",
        "engine_state",
        "protected_targets",
    )
    good = reports.filter("accepted") if "accepted" in reports.columns else reports
    return (
        good.groupBy("device_id")
        .agg(F.max_by(state, F.struct("received_at", "report_id")).alias("s"))
        .select("device_id", "s.*")
    )


def accepted_ids(reports: DataFrame) -> DataFrame:
    """Event ids acknowledged per accepted report (a report holds at most 100 events)."""
    return reports.filter("accepted").select(
        "report_id", F.transform("events", lambda e: e["event_id"]).alias("accepted_event_ids")
    )


def outbox_status(
    queue: DataFrame, acks: DataFrame, max_n: int = 4096, max_bytes: int = 4 << 20, n: int = 100
) -> DataFrame:
    """Where each queued event stands: refused, acknowledged, or waiting in an upload batch."""
    taken = queue_capacity(queue, max_n, max_bytes)
    kept = taken.filter("accepted")
    waiting = batches(ack_anti(kept, acks), n).select("device_id", "event_id", "seq", "batch")
    return (
        taken.join(waiting, ["device_id", "event_id", "seq"], "left")
        .withColumn(
            "status",
            F.when(~F.col("accepted"), "outbox_full")
            .when(F.col("batch").isNull(), "acknowledged")
            .otherwise("waiting"),
        )
        .drop("accepted", "outcome")
    )


def outbox_ack_errors(queue: DataFrame, acks: DataFrame) -> DataFrame:
    return foreign_acks(queue, acks)


def engine_state(reports: DataFrame, policies: DataFrame, as_of: int) -> DataFrame:
    """Add ``effective_state``: running only while some policy applied is unexpired."""
    live = policies.select(
        F.col("revision").alias("applied_revision"), (F.col("expires_at") > as_of).alias("_ok")
    )
    state = F.col("engine_state")
    return (
        reports.join(live, "applied_revision", "left")
        .withColumn(
            "effective_state",
            F.when(state.isin("starting", "stopped"), state)
            .when(F.coalesce("_ok", F.lit(False)), "running")
            .otherwise("policy_unavailable"),
        )
        .drop("_ok")
    )


def audit_check(log: DataFrame, max_bytes: int, chunk: int = 4096) -> DataFrame:
    """Add ``problem`` per record: a sequence gap, or written after the capacity was exhausted.

    Ids must run 1..n. The first record that would exceed ``max_bytes`` fails the writer, so it
    and everything after it is refused even if smaller.
    """
    bucket = F.floor(F.col("event_id") / chunk)
    ran = running(
        log,
        ["log_id"],
        ["event_id"],
        bucket,
        {"_total": ("sum", F.col("bytes"))},
    )
    previous = running(
        ran, ["log_id"], ["event_id"], bucket, {"_prev": ("max", F.col("event_id"))}, False
    )
    # Totals only grow, so a record is past the first overflow exactly when its own total is.
    return previous.withColumn(
        "problem",
        F.when(F.col("_total") > max_bytes, "audit_capacity_exhausted").when(
            F.col("event_id") != F.coalesce("_prev", F.lit(0)) + 1, "sequence_gap"
        ),
    ).drop("_total", "_prev")
