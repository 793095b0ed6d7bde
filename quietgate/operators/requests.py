"""Captured requests, chat turns and page observations: inspect, decide, and record metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as T
from .scan import findings

MAX_BODY_BYTES = 1024 * 1024
MAX_PATH_BYTES = 16384
METHODS = ["GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS"]

def request_guard(df: DataFrame) -> DataFrame:
    """Add ``guard``: the first contract or size violation, NULL when the request may be read."""
    contract = ["id", "host", "method", "path", "content_type", "body"]
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in contract])
    return df.withColumn(
        "guard",
        F.when(missing, "invalid_contract")
        .when(~F.col("host").rlike(r"\A[A-Za-z0-9._:-]{1,253}\z"), "invalid_host")
        .when(~F.col("id").rlike(r"\A[A-Za-z0-9-]{1,64}\z"), "invalid_id")
        .when(F.octet_length("body") > MAX_BODY_BYTES, "body_too_large")
        .when(F.octet_length("path") > MAX_PATH_BYTES, "path_too_large")
        .when(~F.col("method").isin(*METHODS), "unsupported_method"),
    )


def media_type(df: DataFrame, content_type: str = "content_type") -> DataFrame:
    """Add ``media``: ``struct<kind, ascii>`` or NULL."""
    return df.withColumn("media", T.media_type(F.col(content_type)))


def _rules_in_strings(df: DataFrame, strings: str, readable: Column) -> DataFrame:
    """Add ``_rules``: the rules over a set of strings, each as if alone; NULL unless readable."""
    joined = df.withColumn("_joined", F.when(readable, S.join_strings(strings)))
    found = S.rules_of(S.kept_spans("_joined", joined=True))
    return joined.withColumn("_rules", F.when(F.col("_joined").isNotNull(), found)).drop("_joined")


def inspect_requests(df: DataFrame) -> DataFrame:
    """Add ``reason`` and ``rules``; anything that cannot be read completely fails closed.

    Row-local: no shuffle. Only form fields that hold JSON pass through the Arrow helper.
    """
    empty = F.array().cast("array<string>")
    body = F.col("_text")
    kind, ascii_only = F.col("_media.kind"), F.col("_media.ascii")
    read = (
        request_guard(df)
        .withColumn("_path", F.when(F.col("guard").isNull(), T.percent_decode(F.col("path"))))
        .withColumn(
            "_text",
            F.when(F.col("guard").isNull(), F.try_validate_utf8(F.col("body").cast("string"))),
        )
        .withColumn("_media", T.media_type(F.col("content_type")))
    )
    blank = F.octet_length("body") == 0
    refused_ascii = ascii_only & body.rlike(r"[^\x00-\x7F]")
    parsed = read.withColumn(
        "_parts",
        F.when(blank, empty)
        .when(body.isNull() | refused_ascii, F.lit(None))
        .when(kind == "application/json", F.array_append(T.json_strings(body), body))
        .when(kind == "text/plain", F.array(body))
        .when(kind == "application/x-www-form-urlencoded", T.form_parts(body, ascii_only)),
    )
    shaped = F.filter("_parts", lambda p: T.looks_json(p))
    nested = parsed.withColumn(
        "_shaped",
        F.when((kind == "application/x-www-form-urlencoded") & (F.size(shaped) > 0), shaped),
    ).withColumn("_inner", T.embedded_strings()(F.col("_shaped")))
    readable = (
        F.col("_path").isNotNull()
        & F.col("_parts").isNotNull()
        & (F.col("_shaped").isNull() | F.col("_inner").isNotNull())
    )
    strings = F.concat(
        F.array("_path"), F.col("_parts"), F.coalesce(F.col("_inner"), empty)
    )
    found = _rules_in_strings(nested.withColumn("_strings", strings), "_strings", readable)
    reason = (
        F.when(F.col("_rules").isNull(), "uninspectable_request")
        .when(F.size("_rules") == 0, "clean")
        .otherwise("sensitive_data")
    )
    return (
        found.withColumn("reason", reason)
        .withColumn("rules", F.coalesce("_rules", empty))
        .drop("_path", "_text", "_media", "_parts", "_shaped", "_inner", "_strings", "_rules",
              "guard")
    )


def action_of(
    decisions: DataFrame,
    services: dict[str, str] | None = None,
    default_service: str = "other",
) -> DataFrame:
    """Metadata-only event row per decision: allow iff clean, service label by host."""
    allow = F.col("reason") == "clean"
    service = F.lit(default_service)
    for host, label in (services or {}).items():
        service = F.when(F.lower("host") == host.lower(), F.lit(label)).otherwise(service)
    return decisions.select(
        "id",
        "host",
        "method",
        F.octet_length("body").alias("body_len"),
        "reason",
        "rules",
        F.when(allow, "allow").otherwise("block").alias("action"),
        F.when(allow, "logged").otherwise("blocked").alias("event_action"),
        service.alias("service"),
    )


def conversation_scan(conv: DataFrame) -> DataFrame:
    """Per conversation: turns scanned, turns hit, worst severity, first offending turn.

    Findings are reduced to a rank per turn before the shuffle, so no text moves and the
    partial aggregate absorbs a conversation of any length.
    """
    ranked = findings(conv).select(
        "conv_id",
        "turn",
        F.array_max(
            F.transform("findings", lambda f: S.severity_rank(f["severity"]))
        ).alias("rank"),
    )
    return (
        ranked.groupBy("conv_id")
        .agg(
            F.count(F.lit(1)).alias("turns"),
            F.count("rank").alias("turns_hit"),
            F.max("rank").alias("_worst"),
            F.min(F.when(F.col("rank").isNotNull(), F.col("turn"))).alias("first_turn"),
        )
        .withColumn(
            "severity",
            F.get(F.array(*[F.lit(s) for s in S.SEVERITIES]), F.col("_worst")),
        )
        .drop("_worst")
    )


# Texts that mark a human-verification page, and the frame host that serves one.
CHALLENGE_TEXTS = [
    "just a moment",
    "verify you are human",
    "checking your browser",
    "performing security verification",
    "cloudflare security challenge",
    "사람인지 확인하십시오",
]
CHALLENGE_HOST = "challenges.cloudflare.com"


def challenge_text(value: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(value), r"(?U)[\s\x1c-\x1f]+", " "))
    return F.coalesce(
        reduce(lambda a, b: a | b, [F.contains(plain, F.lit(m)) for m in CHALLENGE_TEXTS]),
        F.lit(False),
    )


def challenge(title: Column, body: Column, frames: Column) -> Column:
    """Verification page by its own text, a frame title, or the frame's host."""
    framed = F.exists(
        frames,
        lambda f: challenge_text(f["title"])
        | F.coalesce(
            F.lower(F.try_parse_url(f["url"], F.lit("PROTOCOL"))).isin("http", "https")
            & (F.lower(F.try_parse_url(f["url"], F.lit("HOST"))) == CHALLENGE_HOST),
            F.lit(False),
        ),
    )
    return challenge_text(title) | challenge_text(body) | F.coalesce(framed, F.lit(False))


def page_state(df: DataFrame) -> DataFrame:
    """Add ``result`` from http_status, prompt_box_visible, challenge and login_required."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return df.withColumn(
        "result",
        F.when(flag("challenge"), "challenge_stop")
        .when(flag("login_required"), "login_required")
        .when(F.col("http_status") >= 400, "http_error")
        .when(flag("prompt_box_visible"), "prompt_visible")
        .when(F.col("http_status").isNull(), "unknown")
        .otherwise("page_unavailable"),
    )


# Hosts whose tabs count as evidence; the second is a sign-in page.
CHAT_HOST, LOGIN_HOST = "chatgpt.com", "auth.openai.com"
# Stop reasons, strongest first.
STOP_ORDER = ["challenge_stop", "login_required", "http_error", "page_unavailable", "unknown"]


def select_observation(
    df: DataFrame,
    run: str = "run",
    chat_host: str = CHAT_HOST,
    login_host: str = LOGIN_HOST,
) -> DataFrame:
    """One row per run: the single clean tab, else an ambiguity, else the strongest stop reason.

    A run of any size is folded with partial aggregates (counts and ``min_by``), never gathered.
    """
    eligible = F.col("host").isin(chat_host, login_host)
    states = page_state(
        df.withColumn(
            "login_required",
            (F.col("host") == login_host) | F.coalesce("login_required", F.lit(False)),
        )
    )
    clean = eligible & (F.col("result") == "prompt_visible")
    priority = F.array_position(F.array(*[F.lit(s) for s in STOP_ORDER]), F.col("result"))
    row = F.struct(
        "result",
        "http_status",
        F.coalesce("prompt_box_visible", F.lit(False)).alias("prompt_box_visible"),
        F.coalesce("challenge", F.lit(False)).alias("challenge"),
        "login_required",
        F.col("index").alias("selected_index"),
        "assistant_messages",
        "user_messages",
    )
    best = states.groupBy(run).agg(
        F.count_if(clean).alias("_clean"),
        F.count_if(eligible).alias("_seen"),
        F.min_by(
            row, F.when(eligible, F.struct(F.when(clean, 0).otherwise(priority), F.col("index")))
        ).alias("_best"),
    )
    alone = (F.col("_seen") > 0) & (F.col("_clean") <= 1)
    missing = F.when(F.col("_clean") > 1, "ambiguous_tabs").otherwise("page_unavailable")
    pick = lambda c, other: F.when(alone, F.col(f"_best.{c}")).otherwise(other).alias(c)
    return best.select(
        run,
        pick("result", missing),
        pick("http_status", F.lit(None)),
        pick("prompt_box_visible", F.col("_clean") > 1),
        pick("challenge", F.lit(False)),
        pick("login_required", F.lit(False)),
        pick("selected_index", F.lit(None)),
        pick("assistant_messages", F.lit(None)),
        pick("user_messages", F.lit(None)),
    )
