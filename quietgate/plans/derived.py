"""Inputs of the registered queries, derived from the driver tables.

Each derivation is one SQL text that Spark and DuckDB both run, so a query and its oracle start
from the same rows. In either dialect ``@secs(x)`` is whole seconds since 2024-01-01 and
``@each('a,b')`` one row per list entry.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.rules import RULE_IDS
from ..sources.readers import load

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

def _scored(name: str, m: int, n: int, i: int, keep: int, extra: str = "") -> str:
    """Three-way scores from modular arithmetic; the gold label is favoured except every ``keep``th."""
    return f"""
    SELECT s.*, CASE WHEN p_match >= p_no_match AND p_match >= p_insufficient THEN 'match'
                     WHEN p_no_match >= p_insufficient THEN 'no_match'
                     ELSE 'insufficient' END AS prediction
    FROM (
      SELECT id, doc_id, source_family, policy_id, language, policy_language, gold, split, latency_ms,
             status, tag_list, tokens, model, condition,
             cast(a as double) / cast(a + b + c as double) AS p_match,
             cast(b as double) / cast(a + b + c as double) AS p_no_match,
             cast(c as double) / cast(a + b + c as double) AS p_insufficient
      FROM (
        SELECT g.*, '{name}' AS model, '{extra or 'original'}' AS condition,
               (doc_id * {m} + 11) % 1000 + 1
                 + CASE WHEN gold = 'match' AND doc_id % {keep} <> 0 THEN 2500 + doc_id % 4000 ELSE 0 END AS a,
               (doc_id * {n} + 7) % 1000 + 1
                 + CASE WHEN gold = 'no_match' AND doc_id % {keep} <> 0 THEN 2500 + doc_id % 5000 ELSE 0 END AS b,
               (doc_id * {i} + 3) % 1000 + 1
                 + CASE WHEN gold = 'insufficient' AND doc_id % {keep} <> 0 THEN 2500 + doc_id % 3000 ELSE 0 END AS c
        FROM {{gold}} g
      ) w
    ) s
    """


TEMPLATES: dict[str, str] = {
    # Managed events, with a deterministic share of inconsistent ones.
    "managed": """
    SELECT device_id, n, event_id, received_at, ts_s, timestamp_ms, policy_revision,
           CASE WHEN n % 59 = 0 THEN concat(host, '?q=1') ELSE host END AS host,
           CASE WHEN n % 101 = 0 THEN 'FETCH' ELSE method END AS method,
           CASE WHEN n % 61 = 0 THEN 2000000 ELSE body_len END AS body_len,
           reason, rule_list,
           CASE WHEN n % 53 = 0 THEN 'allow'
                WHEN reason = 'clean' THEN 'allow'
                WHEN reason = 'sensitive_data' AND n % 4 = 1 THEN 'monitor'
                ELSE 'block' END AS action
    FROM (
      SELECT user_id AS device_id, event_id AS n, ts AS received_at,
             concat('00000000-0000-4000-8000-', lpad(cast(event_id as string), 12, '0')) AS event_id,
             cast(@secs(ts) as bigint) AS ts_s,
             cast(@secs(ts) as bigint) * 1000 AS timestamp_ms,
             cast(1 + event_id % 100 as bigint) AS policy_revision,
             concat(event_type, '.example.test') AS host,
             CASE event_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'PATCH' END AS method,
             cast(event_id * 37 % 5000 as bigint) AS body_len,
             CASE WHEN event_type IN ('view', 'click') THEN 'clean'
                  WHEN event_type IN ('purchase', 'signup') THEN 'sensitive_data'
                  ELSE 'uninspectable_request' END AS reason,
             CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'credit_card,email'
                  WHEN event_type = 'purchase' THEN 'credit_card'
                  WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'kr_phone,kr_rrn'
                  WHEN event_type = 'signup' THEN 'email'
                  ELSE '' END AS rule_list
      FROM {events}
    ) e
    """,
    # Local events: id, service, severity and action of an inspected message.
    "local_events": """
    SELECT event_id AS id, ts, event_type AS service,
           CASE WHEN event_id % 3 = 0 THEN 'chatgpt.com' ELSE concat(event_type, '.example.test') END AS host,
           CASE WHEN event_id % 10 = 0 THEN 'output' ELSE 'input' END AS direction,
           CASE WHEN event_type = 'error' THEN 'blocked' WHEN value > 40 THEN 'redacted' ELSE 'logged' END AS action,
           CASE WHEN event_id % 7 = 0 THEN 'critical' WHEN event_id % 7 = 1 THEN 'high'
                WHEN event_id % 7 = 2 THEN 'medium' WHEN event_id % 7 = 3 THEN 'low' END AS severity,
           cast(event_id * 13 % 4000 as bigint) AS chars
    FROM {events}
    """,
    "devices": """
    SELECT c_custkey AS id, c_name AS name,
           CASE WHEN c_custkey % 17 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' END AS revoked_at,
           CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-31 00:00:00'
                ELSE TIMESTAMP '2024-01-30 23:00:00' END AS last_seen,
           cast(c_custkey % 9 as bigint) AS applied_revision
    FROM {customer}
    """,
    # One policy revision per third of a day of events; every fifth expires after two hours.
    "policies": """
    SELECT revision, issued_at,
           issued_at + CASE WHEN revision % 5 = 4 THEN 7200 WHEN revision % 9 = 5 THEN 2592000
                            ELSE 604800 END AS expires_at
    FROM (
      SELECT slot + 1 AS revision, min(s) AS issued_at
      FROM (SELECT cast(floor(@secs(ts) / 28800.0) as bigint) AS slot, cast(@secs(ts) as bigint) AS s
            FROM {events}) x
      WHERE slot % 11 <> 6 AND slot > 3
      GROUP BY slot
    ) p
    """,
    "policy_rules": f"""
    SELECT revision, rule,
           CASE WHEN (revision + length(rule)) % 3 = 0 THEN 'monitor' ELSE 'block' END AS action
    FROM (SELECT revision, @each('{",".join(RULE_IDS)}') AS rule FROM {{policies}}) p
    WHERE (revision + length(rule)) % 10 <> 7
    """,
    # A second, partly different copy of events: retries, conflicts and new ids.
    "resent": """
    SELECT device_id, n, event_id, received_at, ts_s, timestamp_ms, policy_revision, host, method,
           CASE WHEN n % 9 = 0 THEN body_len + 1 ELSE body_len END AS body_len, reason, rule_list, action
    FROM {managed} WHERE n % 3 = 0
    UNION ALL
    SELECT device_id, n, replace(event_id, '-4000-', '-4001-') AS event_id, received_at, ts_s, timestamp_ms,
           policy_revision, host, method, body_len, reason, rule_list, action
    FROM {managed} WHERE n % 5 = 0
    UNION ALL
    SELECT device_id, n, event_id, received_at, ts_s, timestamp_ms, policy_revision, host, method, body_len,
           reason, rule_list, action
    FROM {managed} WHERE n % 6 = 0
    """,
    # Report rows: a device reports once a day; one event in 13 is repeated the day after, and
    # one repeat in four comes with other content.
    "report_rows": """
    SELECT concat(cast(device_id as string), '-', cast(day as string)) AS report_id, device_id, day,
           cast(day * 86400 + 90000 as bigint) AS received_at, event_id, timestamp_ms, policy_revision,
           host, method, body_len, reason, rule_list, action, n
    FROM (
      SELECT device_id, cast(floor(ts_s / 86400.0) as bigint) AS day, event_id, timestamp_ms,
             CASE WHEN policy_revision % 50 = 49 THEN policy_revision ELSE cast(0 as bigint) END AS policy_revision,
             concat(method, '.example.test') AS host, 'POST' AS method, cast(n % 5000 as bigint) AS body_len,
             'clean' AS reason, '' AS rule_list, 'allow' AS action, n
      FROM {managed}
      UNION ALL
      SELECT device_id, cast(floor(ts_s / 86400.0) as bigint) + 1 AS day, event_id, timestamp_ms,
             CASE WHEN policy_revision % 50 = 49 THEN policy_revision ELSE cast(0 as bigint) END AS policy_revision,
             concat(method, '.example.test') AS host, 'POST' AS method,
             cast(n % 5000 + CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END as bigint) AS body_len,
             'clean' AS reason, '' AS rule_list, 'allow' AS action, n
      FROM {managed} WHERE n % 13 = 0
    ) r
    """,
    "installs": """
    SELECT user_id AS device_id, ts, event_id AS seq,
           cast(floor(@secs(ts) / 20000.0) as bigint)
             - CASE WHEN event_id % 19 = 0 THEN 3 ELSE 0 END + 5 AS revision,
           concat('h', cast(cast(floor(@secs(ts) / 20000.0) as bigint) as string),
                  CASE WHEN event_id % 23 = 0 THEN 'x' ELSE '' END) AS content_hash
    FROM {events}
    """,
    "proposals": """
    SELECT event_id AS id, ts, cast(floor(event_id / 3.0) as bigint)
             + CASE WHEN event_id % 29 = 0 THEN 2 ELSE 0 END AS expected_revision
    FROM {events}
    """,
    "tokens": """
    SELECT concat('t', cast(cast(floor(event_id / 4.0) as bigint) as string)) AS token, min(ts) AS issued_at
    FROM {events} GROUP BY concat('t', cast(cast(floor(event_id / 4.0) as bigint) as string))
    """,
    "token_uses": """
    SELECT concat('t', cast(cast(floor(event_id / 4.0) as bigint) as string)) AS token, event_id AS use_id,
           ts AS used_at
    FROM {events}
    """,
    "queue": """
    SELECT device_id, event_id, n AS seq, 200 + n * 7919 % 900 AS bytes FROM {managed}
    """,
    # One acknowledgement in four names the event of another device.
    "acks": """
    SELECT CASE WHEN n % 4 = 0 THEN device_id + 1000000 ELSE device_id END AS device_id, event_id FROM {managed} WHERE n % 3 = 1
    """,
    "audit_log": """
    SELECT device_id AS log_id, event_id, bytes FROM (
      SELECT device_id, cast(row_number() OVER (PARTITION BY device_id ORDER BY n) as bigint) AS event_id,
             200 + n * 7919 % 900 AS bytes, n
      FROM {managed}
    ) a WHERE n % 41 <> 0
    """,
    "attempts": """
    SELECT event_type AS account, event_id AS attempt_id, ts FROM {events}
    """,
    # Requests built from chat turns: plain text, JSON and form bodies.
    "requests": """
    SELECT concat('c', cast(conv_id as string), '-', cast(turn as string)) AS id,
           CASE WHEN conv_id % 2 = 0 THEN 'chatgpt.com' ELSE 'api.example.test' END AS host,
           CASE WHEN conv_id % 31 = 0 THEN 'CONNECT' ELSE 'POST' END AS method,
           CASE WHEN conv_id % 37 = 0 THEN '/v1/chat?q=%FF'
                WHEN conv_id % 41 = 0 THEN '/v1/chat?mail=a.b%40example.test'
                ELSE concat('/v1/chat?turn=', cast(turn as string)) END AS path,
           CASE WHEN conv_id % 43 = 0 THEN 'text/plain; charset=latin1'
                WHEN turn % 3 = 0 THEN 'text/plain; charset=utf-8'
                WHEN turn % 3 = 1 THEN 'application/json'
                ELSE 'application/x-www-form-urlencoded' END AS content_type,
           CASE WHEN turn % 3 = 0 THEN text
                WHEN turn % 3 = 1 THEN concat('{{', chr(34), 'role', chr(34), ':', chr(34), role, chr(34), ',',
                  chr(34), 'text', chr(34), ':', chr(34),
                  replace(replace(replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34))),
                    chr(10), concat(chr(92), 'n')), chr(13), concat(chr(92), 'r')), chr(9), concat(chr(92), 't')),
                  chr(34), '}}', CASE WHEN conv_id % 47 = 0 THEN ',' ELSE '' END)
                ELSE concat('role=', role, '&text=',
                  replace(replace(replace(replace(replace(text, '%', '%25'), '&', '%26'), '+', '%2B'), '=', '%3D'), ' ', '+'))
           END AS body_text,
           text, conv_id, turn
    FROM {conversations}
    """,
    # Documents with one synthetic identifier or near miss appended; built, never stored.
    "planted": """
    SELECT doc_id, lang, source, text AS base, tail, concat(text, ' | ', tail) AS text
    FROM (
      SELECT doc_id, lang, source, text,
        CASE doc_id % 16
          WHEN 0 THEN concat('900101-1', lpad(cast(doc_id % 1000000 as string), 6, '0'))
          WHEN 1 THEN concat('901301-1', lpad(cast(doc_id % 1000000 as string), 6, '0'))
          WHEN 2 THEN concat('010-', lpad(cast(doc_id % 10000 as string), 4, '0'), '-', lpad(cast(doc_id * 7 % 10000 as string), 4, '0'))
          WHEN 3 THEN concat('AK', 'IA', upper(substr(letters, 1, 16)))
          WHEN 4 THEN concat('gh', 'p_', letters, substr(letters, 1, 4))
          WHEN 5 THEN concat('xo', 'xb-', letters)
          WHEN 6 THEN concat('AI', 'za', letters, substr(letters, 1, 3))
          WHEN 7 THEN concat('sk', '-ant-', letters)
          WHEN 8 THEN concat('sk', '-proj-', letters)
          WHEN 9 THEN concat('-----BEGIN ', 'RSA PRIVATE KEY-----', chr(10), '4111111111111111', chr(10), '-----END ', 'RSA PRIVATE KEY-----')
          WHEN 10 THEN concat('-----BEGIN ', 'PRIVATE KEY-----', chr(10), letters)
          WHEN 11 THEN '4111 1111 1111 1111'
          WHEN 12 THEN '4111-1111-1111-1112'
          WHEN 13 THEN concat('user', cast(doc_id as string), '@example.test')
          WHEN 14 THEN concat('123456 ', lpad(cast(4000000000000000 + doc_id * 7919 as string), 16, '0'))
          ELSE 'nothing' END AS tail
      FROM (SELECT doc_id, lang, source, text,
                   translate(md5(cast(doc_id as string)), '0123456789', 'ghijklmnop') AS letters
            FROM {documents}) d
    ) p
    """,
    # Corpus rows: the family is the document source.
    "gold": """
    SELECT d.doc_id AS id, d.doc_id, d.source AS source_family,
           CASE d.doc_id % 4 WHEN 0 THEN 'customer_records' WHEN 1 THEN 'commercial_terms'
                WHEN 2 THEN 'hr_records' ELSE 'strategic_finance' END AS policy_id,
           CASE WHEN d.lang = 'en' THEN 'en' ELSE 'ko' END AS language,
           CASE WHEN d.doc_id % 2 = 0 THEN 'ko' ELSE 'en' END AS policy_language,
           CASE WHEN l.toxic = 1 THEN 'match' WHEN l.quality = 1 THEN 'no_match' ELSE 'insufficient' END AS gold,
           CASE WHEN cast(substr(d.source, 4) as int) % 3 = 0 THEN 'calibration' ELSE 'test' END AS split,
           cast(d.doc_id * 97 % 2003 as double) / 10.0 AS latency_ms,
           CASE WHEN d.doc_id % 23 = 0 THEN 503 ELSE 200 END AS status,
           CASE WHEN d.doc_id % 3 = 0 AND d.doc_id % 5 = 0 THEN 'embedded_instruction,distractor_prefix'
                WHEN d.doc_id % 3 = 0 THEN 'embedded_instruction'
                WHEN d.doc_id % 5 = 0 THEN 'distractor_prefix' ELSE '' END AS tag_list,
           d.n_chars AS tokens
    FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
    """,
    "preds": _scored("alpha", 37, 53, 71, 7),
    "cand": _scored("alpha", 41, 59, 73, 17, "adapted"),
    "rival": _scored("beta", 43, 61, 79, 11),
    "runs": """
    SELECT * FROM {preds} UNION ALL SELECT * FROM {cand} UNION ALL SELECT * FROM {rival}
    """,
    "corpus": """
    SELECT g.id, g.source_family, g.policy_id, g.language, g.policy_language, g.gold, d.text,
           concat('Q:', g.policy_id) AS question, g.tag_list,
           CASE WHEN cast(substr(g.source_family, 4) as int) % 10 < 7 THEN 'train'
                WHEN cast(substr(g.source_family, 4) as int) % 10 = 7 THEN 'dev'
                WHEN cast(substr(g.source_family, 4) as int) % 10 = 8 THEN 'calibration' ELSE 'test' END AS split
    FROM {gold} g JOIN {documents} d ON g.doc_id = d.doc_id
    """,
    # Content requests: scenario, variant and an optional approval per document.
    "content": """
    SELECT doc_id AS request_id,
           CASE doc_id % 6 WHEN 0 THEN 'customer_upload' WHEN 1 THEN 'm365_grounding' WHEN 2 THEN 'drive_personal'
                WHEN 3 THEN 'cloud_summary' WHEN 4 THEN 'rag_acl' ELSE 'agent_mail' END AS scenario_id,
           CASE WHEN doc_id % 4 = 0 THEN 'protected' ELSE 'allowed' END AS variant,
           CASE WHEN doc_id % 71 = 0 THEN '  ' ELSE text END AS text,
           CASE WHEN doc_id % 67 = 0 THEN 'unsupported_text_encoding' END AS extraction_error,
           cast(NULL as string) AS filename_hash,
           CASE WHEN doc_id % 3 = 0 THEN doc_id - doc_id % 2 END AS approval_id
    FROM {planted}
    """,
    # Facts per scenario and variant, derived from the requests that occur.
    "facts": """
    SELECT scenario_id, variant,
           CASE scenario_id WHEN 'customer_upload' THEN 'personal_ai' WHEN 'drive_personal' THEN 'personal_ai'
                WHEN 'cloud_summary' THEN 'approved_ai' WHEN 'agent_mail' THEN 'external_mail'
                ELSE 'internal_ai' END AS destination,
           CASE WHEN scenario_id = 'm365_grounding' AND variant = 'protected' THEN 'ai_processing_prohibited'
                WHEN scenario_id = 'm365_grounding' THEN 'public' ELSE 'unlabelled' END AS document_label,
           NOT (scenario_id = 'rag_acl' AND variant = 'protected') AS acl_allowed,
           TRUE AS tool_allowed
    FROM (SELECT DISTINCT scenario_id, variant FROM {content}) s
    """,
    # Content policies in list order; the two lists are comma-joined.
    "content_policies": """
    SELECT cast(pos as int) AS pos, id, enabled, scenario_list, destination_list, effect, threshold, uncertainty_action
    FROM (
      SELECT DISTINCT g.policy_id AS id,
             CASE g.policy_id WHEN 'customer_records' THEN 0 WHEN 'commercial_terms' THEN 1
                  WHEN 'hr_records' THEN 2 ELSE 3 END AS pos,
             g.policy_id <> 'hr_records' AS enabled,
             CASE WHEN g.policy_id = 'strategic_finance' THEN 'm365_grounding,cloud_summary,customer_upload'
                  ELSE 'customer_upload,drive_personal,agent_mail' END AS scenario_list,
             CASE WHEN g.policy_id = 'strategic_finance' THEN 'internal_ai,approved_ai,personal_ai'
                  ELSE 'personal_ai,external_mail' END AS destination_list,
             CASE WHEN g.policy_id = 'strategic_finance' THEN 'review' ELSE 'block' END AS effect,
             CASE WHEN g.policy_id = 'customer_records' THEN cast(0.6 as double) ELSE cast(0.5 as double) END AS threshold,
             'review' AS uncertainty_action
      FROM {gold} g
    ) p
    """,
    "content_scores": """
    SELECT doc_id AS request_id, score_policy AS policy_id, prediction AS choice, p_match AS match,
           CASE WHEN doc_id % 89 = 0 THEN p_no_match + 0.5 ELSE p_no_match END AS no_match,
           p_insufficient AS insufficient
    FROM (SELECT s.*, @each('customer_records,commercial_terms,hr_records,strategic_finance') AS score_policy FROM {preds} s) x
    WHERE (doc_id + length(score_policy)) % 13 <> 0
    """,
}

_DEPENDS = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def dependencies(name: str) -> list[str]:
    return list(dict.fromkeys(_DEPENDS.findall(TEMPLATES[name])))


_EACH = re.compile(r"@each\(('[^']*')\)")


def _spark_sql(text: str) -> str:
    text = _EACH.sub(r"explode(split(\1, ','))", text)
    return re.sub(
        r"@secs\((\w+)\)",
        r"timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', cast(\1 as timestamp_ntz))",
        text,
    ).replace("TIMESTAMP '", "TIMESTAMP_NTZ '")


def _duck_sql(text: str) -> str:
    plain = _DEPENDS.sub(r"\1", text).replace("{{", "{").replace("}}", "}")
    plain = _EACH.sub(r"unnest(string_split(\1, ','))", plain)
    return re.sub(
        r"@secs\((\w+)\)", r"date_diff('second', TIMESTAMP '2024-01-01 00:00:00', \1)", plain
    )


def frame(
    spark: SparkSession, folder: str, name: str, read: Callable[..., DataFrame] = load
) -> DataFrame:
    """A base table or a derived one; ``read`` may hand out streams instead."""
    if name in BASE:
        return read(spark, folder, name)
    inputs = {d: frame(spark, folder, d, read) for d in dependencies(name)}
    return spark.sql(_spark_sql(TEMPLATES[name]), **inputs)


def with_clause(*names: str) -> str:
    """``WITH`` clause defining the derived tables and what they derive from, for DuckDB."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in BASE or name in order:
            return
        for d in dependencies(name):
            visit(d)
        order.append(name)

    for n in names:
        visit(n)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({_duck_sql(TEMPLATES[n]).strip()})" for n in order)
    return f"WITH {parts}\n" if parts else ""
