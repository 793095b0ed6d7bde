"""Event reports, filters, top-k and fleet queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.clock import instant
from ..functions.rules import RULE_IDS
from ..functions.running import running
from ..operators import aggregates, filters, ingest, joins, sorts
from .catalog import Catalog

CATALOG = Catalog()

SINCE = dt.datetime(2024, 1, 20)
AS_OF = dt.datetime(2024, 1, 31, 0, 0, 10)
_KNOWN = ", ".join(f"'{r}'" for r in RULE_IDS)


def rule_array(df):
    """Comma-joined rule list as an array."""
    empty = F.array().cast("array<string>")
    return df.withColumn(
        "rules", F.when(F.col("rule_list") == "", empty).otherwise(F.split("rule_list", ","))
    ).drop("rule_list")


REJECT = f"""CASE WHEN NOT regexp_full_match(host, '[A-Za-z0-9.:\\[\\]-]{{1,253}}') THEN 'event_host_invalid'
  WHEN method NOT IN ('GET','HEAD','POST','PUT','PATCH','DELETE','OPTIONS','CONNECT','TRACE') THEN 'event_method_invalid'
  WHEN body_len NOT BETWEEN 0 AND 1048576 THEN 'event_invalid'
  WHEN rule_list <> '' AND NOT list_has_all([{_KNOWN}], string_split(rule_list, ',')) THEN 'event_rules_invalid'
  WHEN NOT ((reason = 'clean' AND rule_list = '' AND action = 'allow')
    OR (reason = 'sensitive_data' AND rule_list <> '' AND action IN ('block', 'monitor'))
    OR (reason IN ('uninspectable_request', 'policy_unavailable') AND rule_list = '' AND action = 'block'))
  THEN 'event_decision_invalid' END"""


@CATALOG.add(
    "managed",
    sql="SELECT count(*) AS total, count_if(action = 'block') AS blocked, count_if(action = 'monitor') AS monitored FROM managed",
)
def overview_counts(events):
    return aggregates.overview_counts(events)


@CATALOG.add(
    "local_events",
    sql="""SELECT count(*) AS total, count_if(severity IS NOT NULL) AS detected,
      count_if(severity IN ('critical', 'high')) AS high, count_if(action = 'blocked') AS blocked
    FROM local_events WHERE ts >= TIMESTAMP '2024-01-20'""",
)
def stats_since(events):
    return aggregates.stats(events, SINCE)


@CATALOG.add(
    "local_events",
    sql="""SELECT service, count(*) AS n, count_if(severity IS NOT NULL) AS detected
    FROM local_events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY service""",
)
def by_service(events):
    return aggregates.by_service(events, SINCE)


@CATALOG.add(
    "local_events",
    sql="""SELECT count(*) AS event_count, count_if(action = 'blocked') AS blocked_count, max(ts) AS last_event_ts
    FROM local_events WHERE host = 'chatgpt.com'""",
)
def host_snapshot(events):
    return aggregates.host_snapshot(events, "chatgpt.com")


@CATALOG.add(
    "devices",
    "policies",
    sql="""SELECT count(*) AS total,
      count_if(revoked_at IS NULL AND last_seen > TIMESTAMP '2024-01-30 23:59:40') AS connected,
      count_if(revoked_at IS NULL AND applied_revision <> (SELECT max(revision) FROM policies)) AS pending,
      count_if(revoked_at IS NOT NULL) AS revoked FROM devices""",
)
def fleet_status(devices, policies):
    current = policies.agg(F.max("revision").alias("r")).select("r").scalar()
    return aggregates.fleet_status(devices, current, AS_OF)


@CATALOG.add(
    "local_events", sql="SELECT * FROM local_events WHERE id > 100 ORDER BY id DESC LIMIT 200"
)
def recent(events):
    return filters.recent(events, 200, after_id=100)


@CATALOG.add(
    "local_events",
    sql="SELECT * FROM local_events WHERE id > 0 AND severity IS NOT NULL ORDER BY id DESC LIMIT 50",
)
def recent_detected(events):
    return filters.recent(events, 50, only_findings=True)


@CATALOG.add("local_events", sql="SELECT * FROM local_events WHERE id = 777")
def get_event(events):
    return filters.get_event(events, 777)


@CATALOG.add(
    "local_events", sql="SELECT id, service, action FROM local_events WHERE ts >= TIMESTAMP '2024-01-20'"
)
def since(events):
    return filters.since(events, SINCE).select("id", "service", "action")


@CATALOG.add(
    "managed",
    sql=f"SELECT event_id, coalesce({REJECT}, 'valid') AS verdict FROM managed",
)
def event_valid(events):
    good, bad = filters.event_valid(rule_array(events))
    return good.select("event_id", F.lit("valid").alias("verdict")).unionByName(
        bad.select("event_id", F.col("quarantine_reason").alias("verdict"))
    )


@CATALOG.add(
    "managed",
    sql=f"SELECT coalesce({REJECT}, 'accepted') AS outcome, count(*) AS rows FROM managed GROUP BY 1",
)
def ingest_split(events):
    return ingest.ingest_summary(rule_array(events))


@CATALOG.add("policies", sql="SELECT * FROM policies ORDER BY revision DESC LIMIT 1")
def latest_policy(policies):
    return filters.latest_policy(policies)


@CATALOG.add(
    "tokens",
    sql="""SELECT token FROM tokens WHERE issued_at + INTERVAL 8 HOUR > TIMESTAMP '2024-01-20'""",
)
def active_sessions(tokens):
    sessions = tokens.withColumn("expires_at", F.col("issued_at") + F.expr("INTERVAL 8 HOURS"))
    return filters.active_sessions(sessions, SINCE).select("token")


@CATALOG.add(
    "tokens",
    "token_uses",
    sql="""SELECT t.token FROM tokens t LEFT JOIN (SELECT token, min(used_at) AS used_at FROM token_uses WHERE use_id % 4 > 1 GROUP BY token) u
      ON t.token = u.token WHERE t.issued_at + INTERVAL 15 MINUTE > TIMESTAMP '2024-01-20' AND (used_at IS NULL OR used_at > TIMESTAMP '2024-01-25')""",
)
def usable_tokens(tokens, uses):
    first = uses.filter("use_id % 4 > 1").groupBy("token").agg(F.min("used_at").alias("used_at"))
    state = tokens.join(first, "token", "left").select(
        "token",
        (F.col("issued_at") + F.expr("INTERVAL 15 MINUTES")).alias("expires_at"),
        F.when(
            F.col("used_at") <= instant(uses, "used_at", dt.datetime(2024, 1, 25)), F.col("used_at")
        ).alias("used_at"),
    )
    return filters.usable_tokens(state, SINCE).select("token")


@CATALOG.add(
    "documents",
    sql="SELECT doc_id, CASE WHEN regexp_matches(text, '[가-힣]') THEN 'ko' ELSE 'en' END AS language FROM documents",
)
def language_of(docs):
    return docs.select("doc_id", filters.language_of(F.col("text")).alias("language"))


@CATALOG.add(
    "documents",
    sql="SELECT doc_id, length(text) AS length FROM documents WHERE length(text) > 4000",
)
def over_limit(docs):
    _kept, rejected = filters.over_limit(docs, "text", 4000)
    return rejected.select("doc_id", F.col("length").cast("long").alias("length"))


@CATALOG.add(
    "managed",
    "devices",
    sql="""SELECT m.event_id, m.device_id, d.name AS device_name, m.received_at, m.action
    FROM managed m JOIN devices d ON d.id = m.device_id ORDER BY m.received_at DESC, m.event_id DESC LIMIT 200""",
)
def events_with_device(events, devices):
    return joins.events_with_device(events, devices).select(
        "event_id", "device_id", "device_name", "received_at", "action"
    )


@CATALOG.add(
    "managed",
    sql="SELECT event_id, received_at FROM managed ORDER BY received_at DESC, event_id DESC LIMIT 500",
)
def latest_n(events):
    return sorts.latest_n(events, "received_at", 500, "event_id").select("event_id", "received_at")


@CATALOG.add("local_events", sql="SELECT id, action FROM local_events ORDER BY id DESC LIMIT 500")
def clamped_limit(events):
    return sorts.clamped_limit(events, 9999).select("id", "action")


@CATALOG.add(
    "managed",
    sql="SELECT event_id, action FROM managed ORDER BY received_at DESC, event_id DESC LIMIT 8",
)
def overview_top(events):
    return sorts.overview_top(events).select("event_id", "action")


@CATALOG.add(
    "documents",
    sql="""SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || cast(doc_id as string)), doc_id) AS place FROM documents""",
)
def deterministic_shuffle(docs):
    keyed = docs.select("doc_id", sorts.shuffle_key(F.col("doc_id"), 7).alias("k"))
    placed = running(
        keyed, [], ["k", "doc_id"], F.substring("k", 1, 2), {"place": ("sum", F.lit(1))}
    )
    return sorts.deterministic_shuffle(placed, "doc_id", 7).select("doc_id", "place")


@CATALOG.add(
    "documents",
    sql="""SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(['match', 'no_match', 'insufficient'],
      lambda o: md5('11:' || cast(doc_id as string) || ':' || o) || o)), lambda s: s[33:]), ',') AS options FROM documents""",
)
def shuffled_options(docs):
    return docs.select(
        "doc_id",
        F.array_join(
            sorts.shuffled_options("doc_id", ["match", "no_match", "insufficient"], 11), ","
        ).alias("options"),
    )


@CATALOG.add(
    "documents",
    sql="""SELECT doc_id, n_chars, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 32 AS batch FROM documents""",
)
def length_buckets(docs):
    return sorts.length_buckets(docs.select("doc_id", "n_chars"), "n_chars", "doc_id", 32)
