"""Policy history, decisions under rule policies, and content decisions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import decide as dec
from ..operators import joins, windows
from .catalog import Catalog
from .report_queries import rule_array
from .scan_queries import _CARD_TEXT, marked_sql, rules_sql

CATALOG = Catalog()

REVISION = 5


def with_maps(policies, policy_rules):
    maps = joins.policy_maps(policy_rules).withColumnRenamed("policy_rules", "rules")
    return policies.join(maps, "revision")


@CATALOG.add(
    "policies",
    sql="""SELECT revision, issued_at AS valid_from,
      least(expires_at, coalesce(lead(issued_at) OVER (ORDER BY revision), expires_at)) AS valid_to FROM policies""",
)
def policy_timeline(policies):
    return windows.policy_timeline(policies, span=16)


_IN_FORCE = """SELECT m.*, coalesce((SELECT max(revision) FROM policies p
      WHERE p.issued_at <= m.ts_s + 60 AND p.expires_at > m.ts_s AND p.expires_at > p.issued_at
        AND p.expires_at - p.issued_at <= 604800), 0) AS in_force FROM managed m"""


@CATALOG.add(
    "managed", "policies", "policy_rules",
    sql=f"SELECT event_id, in_force FROM ({_IN_FORCE}) x",
)
def policy_asof(events, policies, policy_rules):
    held = joins.policy_asof(rule_array(events), with_maps(policies, policy_rules))
    return held.select("event_id", "in_force")




@CATALOG.add(
    "managed", "policies", "policy_rules",
    sql=f"""WITH exploded AS (
      SELECT event_id, in_force, unnest(string_split(rule_list, ',')) AS rule FROM ({_IN_FORCE}) f WHERE rule_list <> ''),
    hit AS (SELECT e.event_id, count_if(coalesce(r.action, 'block') <> 'monitor') > 0 AS blocked
      FROM exploded e LEFT JOIN policy_rules r ON r.revision = e.in_force AND r.rule = e.rule GROUP BY e.event_id)
    SELECT f.event_id, f.in_force AS effective_revision,
      CASE WHEN in_force = 0 THEN 'policy_unavailable' WHEN reason IN ('clean', 'sensitive_data') THEN reason
           ELSE 'uninspectable_request' END AS effective_reason,
      CASE WHEN in_force = 0 OR reason NOT IN ('clean', 'sensitive_data') THEN '' ELSE rule_list END AS effective_rules,
      CASE WHEN in_force = 0 THEN 'block' WHEN reason = 'clean' THEN 'allow'
           WHEN reason = 'sensitive_data' AND NOT coalesce(h.blocked, false) THEN 'monitor' ELSE 'block' END AS effective_action
    FROM ({_IN_FORCE}) f LEFT JOIN hit h ON h.event_id = f.event_id""",
)
def effective_action(events, policies, policy_rules):
    decided = dec.effective_action(rule_array(events), with_maps(policies, policy_rules))
    return decided.select(
        "event_id",
        "effective_revision",
        "effective_reason",
        F.array_join("effective_rules", ",").alias("effective_rules"),
        "effective_action",
    )


@CATALOG.add(
    "managed", "policy_rules",
    sql="""WITH exploded AS (
      SELECT event_id, policy_revision, unnest(string_split(rule_list, ',')) AS rule FROM managed WHERE rule_list <> ''),
    hit AS (SELECT e.event_id, count_if(coalesce(r.action, 'block') <> 'monitor') > 0 AS blocked
      FROM exploded e LEFT JOIN policy_rules r ON r.revision = e.policy_revision AND r.rule = e.rule GROUP BY e.event_id)
    SELECT m.event_id, coalesce(h.blocked, false) AS blocked FROM managed m LEFT JOIN hit h ON h.event_id = m.event_id""",
)
def rule_actions(events, policy_rules):
    return joins.rule_actions(rule_array(events), policy_rules).select("event_id", "blocked")


@CATALOG.add(
    "managed", "policies",
    sql="""SELECT DISTINCT policy_revision FROM managed WHERE policy_revision > 0
      AND policy_revision NOT IN (SELECT revision FROM policies)""",
)
def unknown_revisions(events, policies):
    return joins.unknown_revisions(events, policies)


@CATALOG.add(
    "installs",
    sql="""WITH seen AS (
      SELECT *, max(revision) OVER (PARTITION BY device_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top,
             first_value(content_hash) OVER (PARTITION BY device_id, revision ORDER BY ts, seq) AS first_hash FROM installs)
    SELECT device_id, seq, CASE WHEN revision < top THEN 'policy_revision_regressed'
      WHEN revision = top AND content_hash <> first_hash THEN 'policy_revision_conflict' ELSE 'accepted' END AS outcome FROM seen""",
)
def revision_check(installs):
    return windows.revision_check(installs).select("device_id", "seq", "outcome")


@CATALOG.add(
    "proposals",
    sql="""WITH RECURSIVE chain(expected, ts, id) AS (
      SELECT * FROM (SELECT expected_revision, ts, id FROM proposals
        WHERE expected_revision = (SELECT min(expected_revision) FROM proposals) ORDER BY ts, id LIMIT 1) s
      UNION ALL
      SELECT n.expected, n.w.ts, n.w.id FROM (
        SELECT c.expected + 1 AS expected,
               (SELECT min({'ts': p.ts, 'id': p.id}) FROM proposals p
                WHERE p.expected_revision = c.expected + 1 AND (p.ts > c.ts OR (p.ts = c.ts AND p.id > c.id))) AS w
        FROM chain c) n WHERE n.w IS NOT NULL)
    SELECT p.id, CASE WHEN c.id IS NOT NULL THEN 'published' ELSE 'conflict' END AS outcome,
           CASE WHEN c.id IS NOT NULL THEN p.expected_revision + 1 END AS revision
    FROM proposals p LEFT JOIN chain c ON c.expected = p.expected_revision AND c.id = p.id""",
)
def publish_outcome(proposals):
    return windows.publish_outcome(proposals).select("id", "outcome", "revision")


@CATALOG.add(
    "tokens", "token_uses",
    sql="""WITH timed AS (SELECT u.*, u.used_at >= t.issued_at AND u.used_at < t.issued_at + INTERVAL 15 MINUTE AS ok
      FROM token_uses u LEFT JOIN tokens t ON t.token = u.token)
    SELECT token, use_id, ok AND row_number() OVER (PARTITION BY token, ok ORDER BY used_at, use_id) = 1 AS accepted FROM timed""",
)
def token_redeem(tokens, uses):
    return windows.token_redeem(tokens, uses).select("token", "use_id", "accepted")


def content_policy_frame(policies):
    return policies.select(
        "pos",
        "id",
        "enabled",
        F.split("scenario_list", ",").alias("scenarios"),
        F.split("destination_list", ",").alias("destinations"),
        "effect",
        "threshold",
        "uncertainty_action",
    )


@CATALOG.add(
    "content", "facts", "content_policies",
    sql="""SELECT r.request_id, p.id AS policy_id, p.pos FROM content r
      JOIN facts f ON f.scenario_id = r.scenario_id AND f.variant = r.variant
      JOIN content_policies p ON p.enabled AND list_contains(string_split(p.scenario_list, ','), r.scenario_id)
        AND list_contains(string_split(p.destination_list, ','), f.destination)""",
)
def applicable_policies(content, facts, policies):
    requests = content.join(facts, ["scenario_id", "variant"]).select(
        "request_id", "scenario_id", "destination"
    )
    return joins.applicable_policies(requests, content_policy_frame(policies)).select(
        "request_id", "policy_id", "pos"
    )


_FACTS = """CASE WHEN NOT f.acl_allowed THEN 'block:source_acl_denied_before_retrieval'
      WHEN NOT f.tool_allowed THEN 'block:tool_not_delegated'
      WHEN f.document_label = 'ai_processing_prohibited' THEN 'block:label_prohibits_ai_processing'
      WHEN r.extraction_error IS NOT NULL THEN 'block:' || r.extraction_error
      WHEN trim(r.text) = '' THEN 'review:empty_content' END"""
_JOINED = "content r JOIN facts f ON f.scenario_id = r.scenario_id AND f.variant = r.variant"


@CATALOG.add(
    "content", "facts",
    sql=f"SELECT r.request_id, {_FACTS} AS gate FROM {_JOINED}",
)
def gate_facts(content, facts):
    gated = dec.gate_facts(content.join(facts, ["scenario_id", "variant"]))
    return gated.select(
        "request_id", F.concat_ws(":", "facts_gate.action", "facts_gate.reason").alias("_g")
    ).select("request_id", F.when(F.col("_g") != "", F.col("_g")).alias("gate"))


_SECRETS = "['private_key','anthropic_key','openai_key','aws_access_key','github_token','slack_token','google_api_key']"
_PLANTED_RULES = rules_sql("planted", "text", _CARD_TEXT, "doc_id")
# The request text replaces every 71st document by blanks, which no rule matches.
_FOUND = f"SELECT doc_id AS request_id, CASE WHEN doc_id % 71 = 0 THEN '' ELSE rules END AS found FROM ({_PLANTED_RULES}) x"
_PATTERNS = f"""CASE WHEN found <> '' AND list_has_any(string_split(found, ','), {_SECRETS}) THEN 'block:secret_detected'
      WHEN found <> '' AND r.scenario_id = 'cloud_summary' THEN 'redact:supported_identifiers_redacted'
      WHEN found <> '' AND f.destination IN ('personal_ai', 'external_mail') THEN 'block:direct_identifier_detected' END"""


@CATALOG.add(
    "planted", "content", "facts",
    sql=f"""SELECT r.request_id, d.found AS detector_ids, {_PATTERNS} AS gate
    FROM {_JOINED} JOIN ({_FOUND}) d ON d.request_id = r.request_id""",
)
def gate_patterns(_planted, content, facts):
    gated = dec.gate_patterns(content.join(facts, ["scenario_id", "variant"]))
    action, reason = F.col("patterns_gate.action"), F.col("patterns_gate.reason")
    return gated.select(
        "request_id",
        F.array_join("detector_ids", ",").alias("detector_ids"),
        F.concat(action, F.lit(":"), reason).alias("gate"),
    )


_STEPS = """SELECT r.request_id, p.pos,
      CASE WHEN s.choice IS NULL THEN 'block:judge_unavailable'
           WHEN s.choice <> CASE WHEN match >= no_match AND match >= insufficient THEN 'match'
                                 WHEN no_match >= insufficient THEN 'no_match' ELSE 'insufficient' END
             OR match NOT BETWEEN 0 AND 1 OR no_match NOT BETWEEN 0 AND 1 OR insufficient NOT BETWEEN 0 AND 1
             OR abs(match + no_match + insufficient - 1) > 0.001 THEN 'block:invalid_judge_scores'
           WHEN s.choice = 'insufficient' OR greatest(match, no_match, insufficient) < p.threshold
             THEN p.uncertainty_action || ':judge_uncertain'
           WHEN s.choice = 'match' THEN p.effect || ':semantic_policy_match' END AS step
    FROM content r JOIN facts f ON f.scenario_id = r.scenario_id AND f.variant = r.variant
      JOIN content_policies p ON p.enabled AND list_contains(string_split(p.scenario_list, ','), r.scenario_id)
        AND list_contains(string_split(p.destination_list, ','), f.destination)
      LEFT JOIN content_scores s ON s.request_id = r.request_id AND s.policy_id = p.id"""
_SEMANTIC = f"""SELECT request_id, coalesce(arg_min(step, pos) FILTER (WHERE step LIKE 'block:%'),
      arg_max(step, pos) FILTER (WHERE step IS NOT NULL AND step NOT LIKE 'block:%')) AS semantic
    FROM ({_STEPS}) st GROUP BY request_id"""


@CATALOG.add(
    "content", "facts", "content_policies", "content_scores",
    sql=f"SELECT request_id, semantic AS gate FROM ({_SEMANTIC}) x WHERE semantic IS NOT NULL",
)
def gate_semantic(content, facts, policies, scores):
    requests = content.join(facts, ["scenario_id", "variant"])
    gated = dec.gate_semantic(requests, content_policy_frame(policies), scores)
    return gated.select(
        "request_id",
        F.concat_ws(":", "semantic_gate.action", "semantic_gate.reason").alias("gate"),
    )


_GATE = f"""SELECT r.request_id, r.approval_id, r.scenario_id, r.variant, f.destination,
      coalesce({_FACTS}, {_PATTERNS}, 'allow:policy_allowed') AS gate, d.found
    FROM {_JOINED} JOIN ({_FOUND}) d ON d.request_id = r.request_id"""
_DECIDED = f"""SELECT g.*, CASE WHEN gate LIKE 'block:%' OR gate LIKE 'review:%' THEN gate ELSE coalesce(semantic, gate) END AS final
    FROM ({_GATE}) g LEFT JOIN ({_SEMANTIC}) s ON s.request_id = g.request_id"""


def _decisions(content, facts, policies, scores):
    return dec.decide(content, facts, content_policy_frame(policies), scores, REVISION, REVISION)


@CATALOG.add(
    "planted", "content", "facts", "content_policies", "content_scores",
    sql=f"""SELECT request_id, split_part(final, ':', 1) AS action, split_part(final, ':', 2) AS reason,
      cast({REVISION} as bigint) AS policy_revision FROM ({_DECIDED}) x""",
)
def decide(_planted, content, facts, policies, scores):
    return _decisions(content, facts, policies, scores).select(
        "request_id", "action", "reason", "policy_revision"
    )


_UNKNOWN = "(scenario_id = 'rag_acl' AND variant = 'allowed')"


@CATALOG.add(
    "planted", "content", "facts", "content_policies", "content_scores",
    sql=f"""SELECT request_id, CASE WHEN {_UNKNOWN} THEN 'block' ELSE split_part(final, ':', 1) END AS action,
      CASE WHEN {_UNKNOWN} THEN 'unknown_facts' ELSE split_part(final, ':', 2) END AS reason FROM ({_DECIDED}) x""",
)
def decide_unknown_facts(_planted, content, facts, policies, scores):
    """A scenario and variant without facts: its requests are blocked, not lost."""
    known = facts.filter(f"NOT {_UNKNOWN}")
    return _decisions(content, known, policies, scores).select("request_id", "action", "reason")


@CATALOG.add(
    "content", "facts",
    sql="""SELECT r.request_id, sha256('{"content":"' || sha256(r.text) || '","facts":{"acl_allowed":' || f.acl_allowed
      || ',"destination":"' || f.destination || '","document_label":"' || f.document_label || '","tool_allowed":' || f.tool_allowed
      || ',"variant":"' || r.variant || '"},"filename_hash":"' || sha256('') || '","policy_revision":5,"scenario":"' || r.scenario_id || '"}') AS request_digest
    FROM content r JOIN facts f ON f.scenario_id = r.scenario_id AND f.variant = r.variant""",
)
def request_digest(content, facts):
    joined = content.join(facts, ["scenario_id", "variant"])
    return dec.request_digest(joined, REVISION).select("request_id", "request_digest")


def _approvals(decisions):
    """Approvals for reviewed requests: some denied, expired, consumed or bound elsewhere."""
    key = F.col("request_id")
    return decisions.filter("action = 'review'").select(
        (key - key % 2).alias("id"),
        F.when(key % 10 == 9, F.lit("other")).otherwise(F.col("request_digest")).alias("digest"),
        F.when(key % 12 == 6, F.lit(4)).otherwise(F.col("policy_revision")).alias("revision"),
        F.when(key % 14 == 7, "denied").otherwise("approved").alias("status"),
        F.lit(dt.datetime(2024, 1, 20)).alias("expires"),
        F.lit(None).cast("timestamp_ntz").alias("consumed"),
        key.alias("owner"),
    )


def _one_approval(decisions):
    return _approvals(decisions).groupBy("id").agg(
        *[
            F.min_by(c, "owner").alias(c)
            for c in ("digest", "revision", "status", "expires", "consumed")
        ]
    )


_APPROVED = f"""WITH d AS (SELECT request_id, approval_id, split_part(final, ':', 1) AS action, split_part(final, ':', 2) AS reason FROM ({_DECIDED}) x),
    a AS (SELECT request_id - request_id % 2 AS id, min(request_id) AS owner FROM d WHERE action = 'review' GROUP BY 1),
    j AS (SELECT d.*, d.action = 'review' AND a.id IS NOT NULL AND a.owner = d.request_id
            AND a.owner % 10 <> 9 AND a.owner % 12 <> 6 AND a.owner % 14 <> 7 AS fits
          FROM d LEFT JOIN a ON a.id = d.approval_id)
    SELECT request_id,
      CASE WHEN fits THEN 'allow' WHEN approval_id IS NOT NULL AND action <> 'block' THEN 'block' ELSE action END AS action,
      CASE WHEN fits THEN 'bound_human_approval' WHEN approval_id IS NOT NULL AND action <> 'block'
        THEN 'approval_context_invalid_or_consumed' ELSE reason END AS reason FROM j"""


@CATALOG.add(
    "planted", "content", "facts", "content_policies", "content_scores", sql=_APPROVED
)
def approval_match(_planted, content, facts, policies, scores):
    # Decisions are read three times and texts scanned for them once.
    decided = cut(_decisions(content, facts, policies, scores))
    return dec.apply_approvals(
        decided, _one_approval(decided), dt.datetime(2024, 1, 19, 23, 55)
    ).select("request_id", "action", "reason")


@CATALOG.add(
    "planted", "content", "facts", "content_policies", "content_scores",
    sql=f"""SELECT request_id, 'pending' AS status, cast({REVISION} as bigint) AS revision,
      TIMESTAMP '2024-01-20 00:05:00' AS expires FROM ({_DECIDED}) x WHERE final LIKE 'review:%' AND approval_id IS NULL""",
)
def pending_approvals(_planted, content, facts, policies, scores):
    decided = _decisions(content, facts, policies, scores)
    asked = dec.pending_approvals(decided, dt.datetime(2024, 1, 19, 23, 55))
    return asked.select("request_id", "status", "revision", F.col("expires").cast("timestamp_ntz").alias("expires"))


@CATALOG.add(
    "planted", "content", "facts", "content_policies", "content_scores",
    sql=f"""WITH asks AS MATERIALIZED (SELECT request_id AS id, request_id % 4000 AS asked FROM ({_DECIDED}) x
      WHERE final LIKE 'review:%' AND request_id % 4000 <= 1800),
    answers AS (SELECT id, asked, unnest([0, 1]) AS k FROM asks),
    answered AS (SELECT id, asked, t, status FROM (
        SELECT *, asked + (id * 37 + k * 53) % 800 AS t, CASE WHEN (id + k) % 7 = 3 THEN 'denied' ELSE 'approved' END AS status FROM answers) a
      WHERE t <= asked + 600 AND t <= 1800 QUALIFY row_number() OVER (PARTITION BY id ORDER BY t, k) = 1),
    uses AS (SELECT id, asked, t AS since, unnest([0, 1, 2]) AS k FROM answered WHERE status = 'approved'),
    spent AS (SELECT id, 3 * id + k AS used_by FROM (SELECT *, asked + (id * 71) % 300 + k * 150 AS t FROM uses) u
      WHERE (id + k) % 5 <> 4 AND t >= since AND t <= asked + 600 AND t <= 1800 QUALIFY row_number() OVER (PARTITION BY id ORDER BY t, k) = 1)
    SELECT id, used_by, CASE WHEN used_by IS NOT NULL THEN 'consumed' WHEN status = 'denied' THEN 'denied' WHEN asked + 600 < 1800 THEN 'expired'
      ELSE coalesce(status, 'pending') END AS state
    FROM asks LEFT JOIN answered USING (id, asked) LEFT JOIN spent USING (id)""",
)
def approval_replay(_planted, content, facts, policies, scores):
    """Half an hour in which reviewed requests ask for approval, are answered twice and tried three times."""
    start = dt.datetime(2024, 1, 20)
    later = lambda seconds: F.lit(start) + F.make_dt_interval(secs=seconds)
    asked = F.col("id") % 4000
    reviewed = cut(_decisions(content, facts, policies, scores).filter("action = 'review'").select(
        F.col("request_id").alias("id"), F.col("request_digest").alias("digest"), F.col("policy_revision").alias("revision")
    ))
    several = lambda n: reviewed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    answers = several(2).select(
        "id",
        F.col("k").alias("answer_id"),
        F.when((F.col("id") + F.col("k")) % 7 == 3, "denied").otherwise("approved").alias("status"),
        later(asked + (F.col("id") * 37 + F.col("k") * 53) % 800).alias("at"),
    )
    uses = several(3).select(
        "id",
        (F.col("id") * 3 + F.col("k")).alias("request_id"),
        F.when((F.col("id") + F.col("k")) % 5 == 4, "other").otherwise(F.col("digest")).alias("digest"),
        "revision",
        later(asked + (F.col("id") * 71) % 300 + F.col("k") * 150).alias("at"),
    )
    asks = reviewed.withColumn("at", later(asked))
    return dec.replay_approvals(asks, answers, uses, start + dt.timedelta(seconds=1800))


@CATALOG.add(
    "planted", "content", "facts", "content_policies", "content_scores",
    sql=f"""SELECT x.request_id, split_part(final, ':', 1) AS action, sha256(r.text) AS content_hash,
      cast(strlen(r.text) as bigint) AS byte_count
    FROM ({_DECIDED}) x JOIN content r ON r.request_id = x.request_id WHERE final LIKE 'allow:%'""",
)
def release_allowed(_planted, content, facts, policies, scores):
    """Unredacted releases by themselves."""
    decided = _decisions(content, facts, policies, scores)
    out = dec.release_set(decided.filter("action = 'allow'"), content)
    return out.select(
        "request_id", "action", "content_hash", F.col("byte_count").cast("long").alias("byte_count")
    )


@CATALOG.add(
    "planted", "content", "facts", "content_policies", "content_scores",
    sql=f"""WITH RECURSIVE decided AS MATERIALIZED ({_DECIDED}),
    scanned AS MATERIALIZED (SELECT r.request_id AS doc_id, r.text FROM content r JOIN decided d ON d.request_id = r.request_id
      WHERE final LIKE 'redact:%'), {marked_sql("scanned")},
    released AS (SELECT doc_id, t FROM marked UNION ALL SELECT r.request_id, r.text FROM content r JOIN decided d ON d.request_id = r.request_id
      WHERE final LIKE 'allow:%')
    SELECT d.request_id, split_part(final, ':', 1) AS action, split_part(final, ':', 2) AS reason, sha256(t) AS content_hash,
      cast(strlen(t) as int) AS byte_count FROM released x JOIN decided d ON d.request_id = x.doc_id""",
)
def release_set(_planted, content, facts, policies, scores):
    decided = _decisions(content, facts, policies, scores)
    return dec.release_set(decided, content).drop("released_text", "request_digest")
