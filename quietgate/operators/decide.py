"""Policy decisions: managed rule policies, and the ordered gates of content release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.rules import SECRET_RULES
from ..functions.scores import LABELS
from .joins import applicable_policies, blocks, policy_asof
from .scan import findings

# The label that forbids processing, the scenario that redacts instead of
# blocking, and the destinations that direct identifiers may not reach.
PROHIBITED_LABEL = "ai_processing_prohibited"
REDACT_SCENARIOS = ["cloud_summary"]
GUARDED_DESTINATIONS = ["personal_ai", "external_mail"]
APPROVAL_SECONDS = 600


def effective_action(events: DataFrame, policies: DataFrame, bucket: int = 3600) -> DataFrame:
    """Decide each inspected event under the policy in force at ``ts_s``.

    Adds ``effective_reason``, ``effective_rules``, ``effective_action`` and
    ``effective_revision``. Without a policy everything blocks under revision 0.
    """
    held = policy_asof(events, policies, bucket)
    none = F.col("in_force") == 0
    clean, hit = F.col("reason") == "clean", F.col("reason") == "sensitive_data"
    empty = F.array().cast("array<string>")
    return held.select(
        *events.columns,
        F.when(none, "policy_unavailable")
        .when(clean | hit, F.col("reason"))
        .otherwise("uninspectable_request")
        .alias("effective_reason"),
        F.when(~none & (clean | hit), F.col("rules")).otherwise(empty).alias("effective_rules"),
        F.when(none, "block")
        .when(clean, "allow")
        .when(hit & ~blocks(F.col("rules"), F.col("in_force_rules")), "monitor")
        .otherwise("block")
        .alias("effective_action"),
        F.col("in_force").alias("effective_revision"),
    )


def _verdict(action: str, reason) -> Column:
    return F.struct(
        F.lit(action).alias("action"),
        (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
    )


def facts_verdict() -> Column:
    """Hard gates in order: NULL when none applies.

    Text is only extracted for requests that access, tool and label let through, so an
    extraction error comes after them.
    """
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return (
        F.when(no("acl_allowed"), _verdict("block", "source_acl_denied_before_retrieval"))
        .when(no("tool_allowed"), _verdict("block", "tool_not_delegated"))
        .when(
            F.col("document_label") == PROHIBITED_LABEL,
            _verdict("block", "label_prohibits_ai_processing"),
        )
        .when(F.col("extraction_error").isNotNull(), _verdict("block", F.col("extraction_error")))
        .when(
            F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\A[\s\x1c-\x1f]*+\z"),
            _verdict("review", "empty_content"),
        )
    )


def gate_facts(req: DataFrame) -> DataFrame:
    """Add ``facts_gate``: the first hard gate that stops the request, or NULL."""
    return req.withColumn("facts_gate", facts_verdict())


def patterns_verdict(rules: Column) -> Column:
    """Identifier gates in order over the rule ids found in the text."""
    secrets = F.array(*[F.lit(r) for r in SECRET_RULES])
    some = F.size(rules) > 0
    return (
        F.when(F.arrays_overlap(rules, secrets), _verdict("block", "secret_detected"))
        .when(
            some & F.col("scenario_id").isin(*REDACT_SCENARIOS),
            _verdict("redact", "supported_identifiers_redacted"),
        )
        .when(
            some & F.col("destination").isin(*GUARDED_DESTINATIONS),
            _verdict("block", "direct_identifier_detected"),
        )
    )


def gate_patterns(req: DataFrame) -> DataFrame:
    """Add ``detector_ids`` and ``patterns_gate``. Only text no hard gate stopped is scanned."""
    stopped = F.col("facts_gate").isNotNull() if "facts_gate" in req.columns else F.lit(False)
    empty = F.array().cast("array<string>")
    scanned = req.withColumn(
        "detector_ids", F.when(stopped, empty).otherwise(S.rules_in("text"))
    )
    return scanned.withColumn("patterns_gate", patterns_verdict(F.col("detector_ids")))


def score_problem() -> Column:
    """Why a score cannot be used, NULL when it can. Absent scores count as unavailable."""
    cols = [F.col(c) for c in LABELS]
    total = cols[0] + cols[1] + cols[2]
    m, n, i = cols
    best = (
        F.when((m >= n) & (m >= i), "match").when(n >= i, "no_match").otherwise("insufficient")
    )
    bounded = m.between(0, 1) & n.between(0, 1) & i.between(0, 1)
    return (
        F.when(F.col("choice").isNull(), "judge_unavailable")
        .when(
            ~F.coalesce(
                (F.col("choice") == best)
                & bounded
                & (F.abs(total - 1) <= 0.001)
                & ~(F.isnan(m) | F.isnan(n) | F.isnan(i)),
                F.lit(False),
            ),
            "invalid_judge_scores",
        )
    )


def policy_step() -> Column:
    """Outcome of one policy for one request: ``struct<action, reason>``; NULL lets it pass."""
    confidence = (
        F.when(F.col("choice") == "match", F.col("match"))
        .when(F.col("choice") == "no_match", F.col("no_match"))
        .otherwise(F.col("insufficient"))
    )
    doubt = (F.col("choice") == "insufficient") | (confidence < F.col("threshold"))
    problem = score_problem()
    return (
        F.when(problem.isNotNull(), _verdict("block", problem))
        .when(
            doubt,
            F.struct(
                F.col("uncertainty_action").alias("action"),
                F.lit("judge_uncertain").alias("reason"),
            ),
        )
        .when(
            F.col("choice") == "match",
            F.struct(
                F.col("effect").alias("action"), F.lit("semantic_policy_match").alias("reason")
            ),
        )
    )


def gate_semantic(req: DataFrame, policies: DataFrame, scores: DataFrame) -> DataFrame:
    """``(request_id, semantic_gate)`` for requests some applicable policy stopped.

    Policies are read in list order: the first block ends the reading; a later review overwrites
    an earlier one. So the first block decides, else the last review does: two conditional
    ``min_by``/``max_by`` aggregates, with no list per request.
    """
    steps = (
        applicable_policies(req.select("request_id", "scenario_id", "destination"), policies)
        .join(scores, ["request_id", "policy_id"], "left")
        .select("request_id", "pos", policy_step().alias("step"))
    )
    block = F.col("step.action") == "block"
    return (
        steps.groupBy("request_id")
        .agg(
            F.min_by("step", F.when(block, F.col("pos"))).alias("_block"),
            F.max_by(
                "step", F.when(F.col("step").isNotNull() & ~block, F.col("pos"))
            ).alias("_soft"),
        )
        .select("request_id", F.coalesce("_block", "_soft").alias("semantic_gate"))
        .filter(F.col("semantic_gate").isNotNull())
    )


def digest_column(revision: Column) -> Column:
    """SHA-256 binding content, facts, scenario, revision and file name."""
    return F.sha2(
        F.to_json(
            F.struct(
                F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"),
                F.struct("acl_allowed", "destination", "document_label", "tool_allowed", "variant").alias(
                    "facts"
                ),
                F.coalesce("filename_hash", F.sha2(F.lit(""), 256)).alias("filename_hash"),
                revision.alias("policy_revision"),
                F.col("scenario_id").alias("scenario"),
            )
        ),
        256,
    )


def request_digest(req: DataFrame, revision: Column | int = 0) -> DataFrame:
    rev = F.lit(revision) if isinstance(revision, int) else revision
    return req.withColumn("request_digest", digest_column(rev))


def decide(
    requests: DataFrame,
    facts: DataFrame,
    policies: DataFrame,
    scores: DataFrame,
    revision: int,
    current_revision: int | Column | None = None,
) -> DataFrame:
    """Facts, then identifiers, then scored policies; finally the revision is checked again.

    Scores only count for requests the earlier gates let through. Text leaves the job only as a
    digest. A request whose scenario and variant have no facts is blocked as ``unknown_facts``:
    every request gets a decision.
    """
    known = facts.select(
        "scenario_id", "variant", "destination", "document_label", "acl_allowed", "tool_allowed",
        F.lit(True).alias("_known"),
    )
    joined = requests.join(known, ["scenario_id", "variant"], "left")
    if "extraction_error" not in joined.columns:
        joined = joined.withColumn("extraction_error", F.lit(None).cast("string"))
    marked = request_digest(gate_patterns(gate_facts(joined)), revision).drop("text")
    first = marked.withColumn(
        "_gate",
        F.coalesce(
            F.when(F.col("_known").isNull(), _verdict("block", "unknown_facts")),
            "facts_gate", "patterns_gate", _verdict("allow", "policy_allowed"),
        ),
    )
    # Scored from the request keys alone: routing it through ``first`` would scan texts twice.
    scored = gate_semantic(joined, policies, scores)
    passing = F.col("_gate.action").isin("allow", "redact")
    out = first.join(scored, "request_id", "left").withColumn(
        "_final", F.coalesce(F.when(passing, F.col("semantic_gate")), F.col("_gate"))
    )
    changed = (
        F.lit(False)
        if current_revision is None
        else (F.lit(current_revision) if isinstance(current_revision, int) else current_revision)
        != revision
    )
    return out.select(
        "request_id",
        "scenario_id",
        "destination",
        F.when(changed, "block").otherwise(F.col("_final.action")).alias("action"),
        F.when(changed, "policy_changed_during_inspection")
        .otherwise(F.col("_final.reason"))
        .alias("reason"),
        F.lit(revision).cast("long").alias("policy_revision"),
        "request_digest",
        "detector_ids",
        *([c for c in ["approval_id"] if c in out.columns]),
    )


def apply_approvals(
    decisions: DataFrame, approvals: DataFrame, as_of, arrived: str = "request_id"
) -> DataFrame:
    """Let a bound human approval release a reviewed request, once.

    An approval counts when approved, unconsumed, unexpired and for this very digest and
    revision. Among requests presenting it the first to arrive (by ``arrived``, then id) uses it
    up. A request that presents an approval it may not use is blocked; a block is never lifted.
    """
    keyed = approvals.select(
        F.col("id").alias("approval_id"),
        F.col("digest").alias("_digest"),
        F.col("revision").alias("_revision"),
        (
            (F.col("status") == "approved")
            & F.col("consumed").isNull()
            & (F.col("expires") >= F.lit(as_of))
        ).alias("_usable"),
    )
    joined = decisions.join(keyed, "approval_id", "left").withColumn(
        "_fits",
        (F.col("action") == "review")
        & F.coalesce(
            F.col("_usable")
            & (F.col("_digest") == F.col("request_digest"))
            & (F.col("_revision") == F.col("policy_revision")),
            F.lit(False),
        ),
    )
    spent = joined.filter("_fits").groupBy("approval_id").agg(
        F.min(F.struct(F.col(arrived).alias("at"), F.col("request_id").alias("user"))).getField("user").alias("_user")
    )
    out = joined.join(spent, "approval_id", "left")
    granted = F.coalesce(F.col("_fits") & (F.col("request_id") == F.col("_user")), F.lit(False))
    presented = F.col("approval_id").isNotNull() & (F.col("action") != "block")
    return out.select(
        *[c for c in decisions.columns if c not in ("action", "reason")],
        F.when(granted, "allow")
        .when(presented, "block")
        .otherwise(F.col("action"))
        .alias("action"),
        F.when(granted, "bound_human_approval")
        .when(presented, "approval_context_invalid_or_consumed")
        .otherwise(F.col("reason"))
        .alias("reason"),
    )


def pending_approvals(decisions: DataFrame, now) -> DataFrame:
    """The approval that each reviewed request without one asks for.

    Pending, for this digest and revision only, and good for ``APPROVAL_SECONDS``.
    """
    asked = decisions.filter((F.col("action") == "review") & F.col("approval_id").isNull())
    return asked.select(
        "request_id",
        F.col("request_digest").alias("digest"),
        F.col("policy_revision").alias("revision"),
        F.lit("pending").alias("status"),
        (F.lit(now) + F.make_dt_interval(secs=F.lit(APPROVAL_SECONDS))).alias("expires"),
    )


def resolve_approvals(approvals: DataFrame, answers: DataFrame, now) -> DataFrame:
    """Approvals with the answers given at ``now``: only a pending, unexpired one changes.

    ``answers(id, status)``: approved or denied, one for each id.
    """
    told = answers.select("id", F.col("status").alias("_answer"))
    open_ = (F.col("status") == "pending") & (F.col("expires") >= F.lit(now))
    return approvals.join(told, "id", "left").withColumn(
        "status", F.when(open_ & F.col("_answer").isNotNull(), F.col("_answer")).otherwise(F.col("status"))
    ).drop("_answer")


def replay_approvals(asks: DataFrame, answers: DataFrame, uses: DataFrame, now) -> DataFrame:
    """``id, state, used_by``: each approval asked for by ``now``, after what arrived by then.

    ``asks(id, digest, revision, at)``, ``answers(id, answer_id, status, at)`` and
    ``uses(id, request_id, digest, revision, at)`` count in order of arrival: by time, at one
    time asks before answers before uses, and then by their own ids. An approval is good for
    ``APPROVAL_SECONDS`` from its first ask, that second included. The first answer in that time
    decides it; if it is approved the first later use in that time for the same digest and
    revision spends it. An answer or use without an ask, or null in what it must fit, does
    nothing. States: pending, approved, denied, consumed, expired.

    Three joins by id, each followed by a minimum that shrinks before it is shuffled.
    """
    until = F.lit(now)
    opened = (
        asks.filter((F.col("at") <= until) & F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min(F.struct("at", "digest", "revision")).alias("_ask"))
        .withColumn("_expires", F.col("_ask.at") + F.make_dt_interval(secs=F.lit(APPROVAL_SECONDS)))
    )
    in_time = F.col("at").between(F.col("_since"), F.least("_expires", until))
    answered = (
        answers.select("id", "answer_id", "status", "at")
        .join(opened.select("id", F.col("_ask.at").alias("_since"), "_expires"), "id")
        .filter(in_time & F.col("status").isin("approved", "denied"))
        .groupBy("id")
        .agg(F.min(F.struct("at", "answer_id", "status")).alias("_answer"))
    )
    told = opened.join(answered, "id", "left")
    bound = told.filter(F.col("_answer.status") == "approved").select(
        "id", F.col("_ask.digest").alias("digest"), F.col("_ask.revision").alias("revision"),
        F.col("_answer.at").alias("_since"), "_expires",
    )
    spent = (
        uses.select("id", "request_id", "digest", "revision", "at")
        .join(bound, ["id", "digest", "revision"])
        .filter(in_time)
        .groupBy("id")
        .agg(F.min(F.struct("at", "request_id")).getField("request_id").alias("used_by"))
    )
    state = (
        F.when(F.col("used_by").isNotNull(), "consumed")
        .when(F.col("_answer.status") == "denied", "denied")
        .when(F.col("_expires") < until, "expired")
        .otherwise(F.coalesce("_answer.status", F.lit("pending")))
    )
    return told.join(spent, "id", "left").select("id", state.alias("state"), "used_by")


def release_set(decisions: DataFrame, requests: DataFrame) -> DataFrame:
    """What may leave: allowed text as it is, redacted text redacted, with a receipt.

    The receipt (hash and byte count) is of the text actually released.
    """
    go = decisions.filter(F.col("action").isin("allow", "redact")).select(
        "request_id", "action", "reason", "request_digest"
    )
    texts = go.join(
        requests.select("request_id", F.coalesce("text", F.lit("")).alias("text")), "request_id"
    )
    # Allowed text has no reason to be scanned again.
    redact = F.col("action") == "redact"
    found = findings(texts.withColumn("_scan", F.when(redact, F.col("text"))), "_scan")
    return (
        found.withColumn("released_text", S.redacted(F.col("text"), F.col("findings")))
        .drop("text", "_scan", "findings")
        .withColumn("content_hash", F.sha2("released_text", 256))
        .withColumn("byte_count", F.octet_length("released_text"))
    )
