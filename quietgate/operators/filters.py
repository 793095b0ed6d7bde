"""Row filters and predicates over events, policies, sessions and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import instant
from ..functions.rules import RULE_IDS
from ..functions.text import language_of  # noqa: F401 - part of this module's interface

# Domains of a managed event.
EVENT_METHODS = ["GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "CONNECT", "TRACE"]
MAX_SAFE_INTEGER = 9007199254740991
MAX_BODY_LEN = 1048576


def recent(
    events: DataFrame, limit: int = 200, only_findings: bool = False, after_id: int = 0
) -> DataFrame:
    """Newest events above an id; a top-k, never a full sort."""
    out = events.filter(F.col("id") > after_id)
    if only_findings:
        out = out.filter(F.col("severity").isNotNull())
    return out.orderBy(F.desc("id")).limit(limit)


def get_event(events: DataFrame, event_id: int, key: str = "id") -> DataFrame:
    return events.filter(F.col(key) == event_id)


def since(events: DataFrame, ts) -> DataFrame:
    """Events at or after ``ts``; the predicate reaches the Parquet scan."""
    return events.filter(F.col("ts") >= instant(events, "ts", ts))


def event_reject_reason() -> Column:
    """First rule a managed event breaks, NULL when it is consistent."""
    n = F.size("rules")
    clean = F.col("reason") == "clean"
    sensitive = F.col("reason") == "sensitive_data"
    closed = F.col("reason").isin("uninspectable_request", "policy_unavailable")
    known = F.forall("rules", lambda r: r.isin(*RULE_IDS))
    safe = lambda c, top=MAX_SAFE_INTEGER: F.col(c).between(0, top)
    required = [
        "event_id", "timestamp_ms", "policy_revision", "host", "method", "body_len", "reason",
        "rules", "action",
    ]
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    return (
        F.when(missing, "event_incomplete")
        .when(
            ~F.col("event_id").rlike(
                r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
            ),
            "event_id_invalid",
        )
        .when(~F.col("host").rlike(r"\A[A-Za-z0-9.:\[\]-]{1,253}\z"), "event_host_invalid")
        .when(~F.col("method").isin(*EVENT_METHODS), "event_method_invalid")
        .when(
            ~(safe("timestamp_ms") & safe("policy_revision") & safe("body_len", MAX_BODY_LEN)),
            "event_invalid",
        )
        .when(~known | (n != F.size(F.array_distinct("rules"))), "event_rules_invalid")
        .when(
            ~(
                (clean & (n == 0) & (F.col("action") == "allow"))
                | (sensitive & (n > 0) & F.col("action").isin("block", "monitor"))
                | (closed & (n == 0) & (F.col("action") == "block"))
            ),
            "event_decision_invalid",
        )
    )


def event_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into consistent events and a quarantine with the reason for each reject."""
    marked = events.withColumn("quarantine_reason", event_reject_reason())
    return (
        marked.filter(F.col("quarantine_reason").isNull()).drop("quarantine_reason"),
        marked.filter(F.col("quarantine_reason").isNotNull()),
    )


def latest_policy(policies: DataFrame) -> DataFrame:
    """The newest revision, by a partial-aggregated ``max_by`` rather than a sort."""
    cols = policies.columns
    return policies.agg(F.max_by(F.struct(*cols), "revision").alias("p")).select("p.*")


def active_sessions(sessions: DataFrame, as_of) -> DataFrame:
    return sessions.filter(F.col("expires_at") > instant(sessions, "expires_at", as_of))


def usable_tokens(tokens: DataFrame, as_of) -> DataFrame:
    """Enrolment tokens that are unexpired, unused and not revoked."""
    unexpired = F.col("expires_at") > instant(tokens, "expires_at", as_of)
    out = tokens.filter(unexpired & F.col("used_at").isNull())
    if "revoked_at" in tokens.columns:
        out = out.filter(F.col("revoked_at").isNull())
    return out


def over_limit(df: DataFrame, col: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Reject over-long inputs instead of cutting them: ``(kept, rejected)``."""
    size = F.length(col)
    return (
        df.filter(F.coalesce(size <= n, F.lit(True))),
        df.filter(size > n).withColumn("length", size),
    )
