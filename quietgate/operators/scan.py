"""Corpus scan jobs: which documents hold sensitive data, where, and what may be shown of it.

Everything up to ``corpus_profile`` is row-local, so a scan is one narrow stage whatever the
table size; only per-rule counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.rules import RULE_IDS, SEVERITIES


def each(df: DataFrame, array: str, name: str, *keep: str) -> DataFrame:
    """One row per element of a computed array.

    ``explode`` makes the optimizer infer ``size(array) > 0`` and push it below the projection
    that computes the array, so the scan would run again for the test. ``explode_outer`` with
    the test after it keeps the scan single.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def rule_hits(df: DataFrame, text: str = "text", enabled: Iterable[str] | None = None) -> DataFrame:
    """Add ``rules``: the sorted ids of the rules that fire."""
    return df.withColumn("rules", S.rules_in(text, enabled))


def scan_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``candidates``: every span of every rule before overlaps are resolved."""
    value = F.col(text)

    def describe(s: Column) -> Column:
        return F.struct(
            s["prio"].alias("prio"),
            S.rule_name(s["prio"]).alias("rule"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.substr(value, s["start"] + 1, s["end"] - s["start"]).alias("value"),
        )

    raw = S.candidate_spans(F.coalesce(value, F.lit("")))
    return df.withColumn("candidates", F.array_sort(F.transform(raw, describe)))


def findings(df: DataFrame, text: str = "text", enabled: Iterable[str] | None = None) -> DataFrame:
    """Add ``findings`` in text order: rule, label, severity, masked value and offsets."""
    # Two projections: nested any deeper, the expression would exceed the analyzer's rounds.
    return (
        df.withColumn("_spans", S.kept_spans(text, enabled))
        .withColumn("findings", S.findings_from(F.col(text), F.col("_spans")))
        .drop("_spans")
    )


def severity(df: DataFrame) -> DataFrame:
    """Add ``severity``: the worst finding's, NULL when nothing was found."""
    return df.withColumn("severity", S.max_severity(F.col("findings")))


def redact(df: DataFrame, text: str = "text", enabled: Iterable[str] | None = None) -> DataFrame:
    """Replace ``text`` by its redacted form; the raw text does not survive the projection."""
    marked = findings(df, text, enabled)
    return marked.withColumn(text, S.redacted(F.col(text), F.col("findings"))).drop("findings")


def masked_preview(
    df: DataFrame,
    text: str = "text",
    limit: int = 400,
    enabled: Iterable[str] | None = None,
) -> DataFrame:
    """Replace ``text`` by a bounded masked preview."""
    marked = findings(df, text, enabled)
    return marked.withColumn(
        "preview", S.preview(F.col(text), F.col("findings"), limit)
    ).drop("findings", text)


def finding_metadata(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Metadata-only view of findings: no masked value, no offsets, no text."""
    slim = F.transform(
        "findings",
        lambda f: F.struct(
            f["rule"].alias("rule"), f["label"].alias("label"), f["severity"].alias("severity")
        ),
    )
    return df.select(
        *keep, slim.alias("findings"), S.max_severity(F.col("findings")).alias("severity")
    )


def known_rule_filter(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Re-derive finding labels from the rule table and clamp fields outside their domain.

    Stored labels, masked values and offsets are never passed on. ``rules`` is the fixed rule
    dimension; it is folded to a single map row and attached to every event.
    """
    lookup = rules.agg(
        F.map_from_entries(
            F.collect_list(F.struct("rule", F.struct("label", F.col("severity").alias("sev"))))
        ).alias("_rules")
    )
    known = F.filter("findings", lambda f: F.map_contains_key("_rules", f["rule"]))
    clean = F.transform(
        known,
        lambda f: F.struct(
            f["rule"].alias("rule"),
            F.col("_rules")[f["rule"]]["label"].alias("label"),
            F.col("_rules")[f["rule"]]["sev"].alias("severity"),
        ),
    )
    return (
        events.join(F.broadcast(lookup))
        .withColumn("findings", clean)
        .withColumn(
            "action",
            F.when(F.col("action").isin("logged", "blocked"), F.col("action")).otherwise(
                F.lit("blocked")
            ),
        )
        .withColumn("severity", F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")))
        .drop("_rules")
    )


def corpus_profile(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    enabled: Iterable[str] | None = None,
    totals: bool = False,
) -> DataFrame:
    """Documents scanned, hit and high per key, with one hit count per rule.

    Rule counts are conditional sums over the rule array rather than an explode, so a document
    contributes one row to one partial aggregate. ``totals`` adds rollup rows.
    """
    wanted = [r for r in RULE_IDS if enabled is None or r in set(enabled)]
    hits = df.select(*keys, S.rules_in(text, wanted).alias("rules"))
    urgent = F.array(
        *[F.lit(r.rule) for r in S.RULES if r.severity in ("critical", "high")]
    )
    grouped = hits.rollup(*keys) if totals else hits.groupBy(*keys)
    return grouped.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.size("rules") > 0).alias("hit"),
        F.count_if(F.arrays_overlap("rules", urgent)).alias("high"),
        *[F.count_if(F.array_contains("rules", r)).alias(f"n_{r}") for r in wanted],
    )


def rule_counts(df: DataFrame, keys: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Long form of the profile: documents per key and rule."""
    hits = df.select(*keys, S.rules_in(text).alias("rules"))
    return (
        each(hits, "rules", "rule", *keys)
        .groupBy(*keys, "rule")
        .agg(F.count(F.lit(1)).alias("documents"))
    )
