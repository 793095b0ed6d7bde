"""Event reports and evaluation metrics. Every one is a partial-aggregated reduction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import instant
from ..functions.running import order_statistics
from ..functions.scores import LABELS, gate, routed, score_of


def overview_counts(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("action") == "block").alias("blocked"),
        F.count_if(F.col("action") == "monitor").alias("monitored"),
    )


def stats(events: DataFrame, since) -> DataFrame:
    return events.filter(F.col("ts") >= instant(events, "ts", since)).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity").isNotNull()).alias("detected"),
        F.count_if(F.col("severity").isin("critical", "high")).alias("high"),
        F.count_if(F.col("action") == "blocked").alias("blocked"),
    )


def by_service(events: DataFrame, since) -> DataFrame:
    return (
        events.filter(F.col("ts") >= instant(events, "ts", since))
        .groupBy("service")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("severity").isNotNull()).alias("detected"),
        )
        .orderBy(F.desc("n"), "service")
    )


def host_snapshot(events: DataFrame, host: str) -> DataFrame:
    return events.filter(F.col("host") == host).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.col("action") == "blocked").alias("blocked_count"),
        F.max("ts").alias("last_event_ts"),
    )


def fleet_status(devices: DataFrame, current_revision: Column | int, as_of) -> DataFrame:
    """Connected within 30 s, waiting for the current revision, total and revoked."""
    live = F.col("revoked_at").isNull()
    now = instant(devices, "last_seen", as_of)
    seen = F.col("last_seen") > now - F.expr("INTERVAL 30 SECONDS")
    current = F.lit(current_revision) if isinstance(current_revision, int) else current_revision
    return devices.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(live & seen).alias("connected"),
        F.count_if(live & (F.col("applied_revision") != current)).alias("pending"),
        F.count_if(~live).alias("revoked"),
    )


HISTOGRAMS = {
    "label": "gold",
    "language": "language",
    "policy_language": "policy_language",
    "policy": "policy_id",
}


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of a row's JSON, its fields in order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def split_manifest(
    corpus: DataFrame, removed: DataFrame | None = None, digest: Column | None = None
) -> DataFrame:
    """One row per split: sizes, distinct families and documents, an order-free content hash.

    The hash adds up 60-bit pieces of each row's SHA-256 as exact decimals: no task ever holds a split's
    rows, and any partitioning gives the same value. ``removed`` carries ``(split, rows)``
    dropped as duplicates; ``digest`` is the rows' :func:`row_digest` where it is known already.
    """
    rows = corpus.withColumn("_digest", row_digest(corpus.columns) if digest is None else digest)
    lane = lambda at: F.sum(
        F.conv(F.substring("_digest", at, 15), 16, 10).cast("decimal(20,0)")
    )
    content = F.sha2(F.concat_ws(":", lane(1), lane(16), lane(31), lane(46), F.count(F.lit(1))), 256)
    out = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("source_family").alias("families"),
        F.count_distinct("document_id").alias("documents"),
        content.alias("content_hash"),
    )
    if removed is not None:
        out = out.join(
            removed.groupBy("split").agg(F.sum("rows").alias("duplicates_removed")), "split", "left"
        ).na.fill(0, ["duplicates_removed"])
    return out


def split_histograms(corpus: DataFrame) -> DataFrame:
    """Label, language, policy-language and policy counts per split, in one aggregation."""
    pairs = F.array(
        *[
            F.struct(F.lit(k).alias("dimension"), F.col(c).cast("string").alias("value"))
            for k, c in HISTOGRAMS.items()
            if c in corpus.columns
        ]
    )
    return (
        corpus.select("split", F.inline(pairs))
        .groupBy("split", "dimension", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def summary_columns() -> list[Column]:
    """Accuracy and the error kinds that matter, as aggregates."""
    gold, pred = F.col("gold"), F.col("prediction")
    n = F.count(F.lit(1))
    correct = F.count_if(gold == pred)
    missed = F.count_if((gold == "match") & (pred == "no_match"))
    return [
        n.alias("n"),
        correct.alias("correct"),
        (correct / n).alias("accuracy"),
        missed.alias("match_to_no_match"),
        F.count_if((gold == "insufficient") & (pred == "no_match")).alias(
            "insufficient_to_no_match"
        ),
        F.count_if((gold == "no_match") & (pred == "match")).alias("no_match_to_match"),
        F.try_divide(missed, F.count_if(gold == "match")).alias("sensitive_miss_rate"),
    ]


def summarize(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return preds.groupBy(*by).agg(*summary_columns())


def confusion(preds: DataFrame) -> DataFrame:
    """All nine (gold, prediction) cells, zeros included, from nine conditional counts."""
    cells = [(g, p) for g in LABELS for p in LABELS]
    counts = preds.agg(
        *[
            F.count_if((F.col("gold") == g) & (F.col("prediction") == p)).alias(f"{g}|{p}")
            for g, p in cells
        ]
    )
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(g).alias("gold"),
                        F.lit(p).alias("prediction"),
                        F.col(f"`{g}|{p}`").alias("n"),
                    )
                    for g, p in cells
                ]
            )
        )
    )


SLICE_KEYS = ["language", "policy_language", "policy_id"]


def slices(preds: DataFrame, keys: Sequence[str] = tuple(SLICE_KEYS)) -> DataFrame:
    """``summarize`` for each key alone plus the total: grouping sets, one pass."""
    keys = list(keys)
    sets = [[k] for k in keys] + [[]]
    grouped = preds.groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys]
    ).agg(*summary_columns(), F.grouping_id(*keys).alias("_g"))
    names = F.lit("all")
    value = F.lit(None).cast("string")
    for i, k in enumerate(keys):
        bit = ((1 << len(keys)) - 1) & ~(1 << (len(keys) - 1 - i))
        names = F.when(F.col("_g") == bit, F.lit(k)).otherwise(names)
        value = F.when(F.col("_g") == bit, F.col(k).cast("string")).otherwise(value)
    return grouped.withColumn("slice", names).withColumn("value", value).drop("_g", *keys)


def tag_slices(preds: DataFrame) -> DataFrame:
    """``summarize`` per tag; a row counts once in each of its tags."""
    tagged = preds.withColumn("tag", F.explode(F.array_distinct("tags")))
    return summarize(tagged, ["tag"])


def action_columns(action: Column) -> list[Column]:
    gold = F.col("gold")
    both = lambda g, a: F.count_if((gold == g) & (action == a))
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(action == "block").alias("block"),
        F.count_if(action == "allow").alias("allow"),
        F.count_if(action == "review").alias("review"),
        both("match", "allow").alias("sensitive_allowed"),
        both("insufficient", "allow").alias("ambiguous_allowed"),
        both("no_match", "block").alias("safe_blocked"),
        both("insufficient", "block").alias("ambiguous_blocked"),
        both("no_match", "allow").alias("safe_allowed"),
        both("match", "block").alias("sensitive_blocked"),
    ]


def action_counts(preds: DataFrame, gates: DataFrame | dict, by: Sequence[str] = ()) -> DataFrame:
    acted = preds.withColumn("_action", routed(gate(gates, "allow"), gate(gates, "block")))
    return acted.groupBy(*by).agg(*action_columns(F.col("_action")))


def _grouped_with(df: DataFrame, extra: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        return df.join(extra, list(by), "left")
    return df.join(F.broadcast(extra), how="left")


def latency_summary(
    runs: DataFrame, by: Sequence[str], value: str = "latency_ms", ok: str | None = None
) -> DataFrame:
    """Median (mean of the middle two) and p95 at index ``int((n-1)*0.95)``, exactly.

    With ``ok`` (a boolean column) success count and the p95 of successes are added.
    """
    n = F.col("n")
    ranks = {
        "_lo": F.floor((n - 1) / 2),
        "_hi": F.floor(n / 2),
        "p95": F.floor((n - 1) * F.lit(0.95)),
    }
    out = order_statistics(runs, by, value, ranks).select(
        *by, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias("p50"), "p95"
    )
    if ok is None:
        return out
    good = order_statistics(
        runs.filter(F.col(ok)), by, value, {"p95_ok": ranks["p95"]}
    ).select(*by, F.col("n").alias("success"), "p95_ok")
    return _grouped_with(out, good, by).na.fill(0, ["success"])


def latency_linear(runs: DataFrame, by: Sequence[str], value: str = "latency_ms") -> DataFrame:
    """p50 and p95 with linear interpolation between neighbours, exactly."""
    n = F.col("n")
    ranks = {}
    for q in (50, 95):
        at = (n - 1) * F.lit(q / 100)
        ranks[f"_l{q}"], ranks[f"_h{q}"] = F.floor(at), F.ceil(at)
    stat = order_statistics(runs, by, value, ranks)

    def mix(q: int) -> Column:
        at = (n - 1) * F.lit(q / 100)
        lo, hi = F.col(f"_l{q}"), F.col(f"_h{q}")
        return (lo + (hi - lo) * (at - F.floor(at))).alias(f"p{q}")

    return stat.select(*by, "n", mix(50), mix(95))


def token_audit(df: DataFrame, by: Sequence[str], tokens: str = "tokens") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(tokens).alias("min_tokens"),
        F.max(tokens).alias("max_tokens"),
        F.avg(tokens).alias("mean_tokens"),
    )


def margin_diagnostic(preds: DataFrame) -> DataFrame:
    """Per automatic label: median right score, highest wrong score, right scores above it."""
    label, right = F.col("prediction"), F.col("gold") == F.col("prediction")
    rows = preds.select(label.alias("label"), score_of(label).alias("score"), right.alias("right"))
    # Two labels, two numbers each: one row per pass, read as scalars, so both labels appear
    # even when a side is empty.
    sides = ("match", "no_match")
    top = rows.agg(
        *[
            F.coalesce(
                F.max(F.when((F.col("label") == x) & ~F.col("right"), F.col("score"))),
                F.lit(0.0),
            ).alias(x)
            for x in sides
        ]
    )
    above = rows.agg(
        *[
            F.count_if(
                (F.col("label") == x) & F.col("right") & (F.col("score") > top.select(x).scalar())
            ).alias(x)
            for x in sides
        ]
    )
    n = F.col("n")
    mid = order_statistics(
        rows.withColumn("_good", F.when(F.col("right"), F.col("score"))),
        ["label"],
        "_good",
        {"_lo": F.floor((n - 1) / 2), "_mid": F.floor(n / 2)},
    ).select("label", ((F.col("_lo") + F.col("_mid")) / 2).alias("median_right"))
    return (
        above.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(x).alias("label"),
                            top.select(x).scalar().alias("highest_wrong"),
                            F.col(x).alias("right_above"),
                        )
                        for x in sides
                    ]
                )
            )
        )
        .join(mid, "label", "left")
        .na.fill(0.0, ["median_right"])
    )


def resource_peak(
    runs: DataFrame, by: Sequence[str], resources: Sequence[str], tokens: str = "input_tokens"
) -> DataFrame:
    return runs.groupBy(*by).agg(
        *[F.max(c).alias(f"peak_{c}") for c in resources],
        F.min(tokens).alias("min_tokens"),
        F.max(tokens).alias("max_tokens"),
    )


def agreement(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """How often two runtimes choose alike, and the largest score difference."""
    cols = ["prediction", "p_match", "p_no_match", "p_insufficient"]
    left = a.select(key, *[F.col(c).alias(f"a_{c}") for c in cols])
    right = b.select(key, *[F.col(c).alias(f"b_{c}") for c in cols])
    delta = F.greatest(*[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in cols[1:]])
    same = F.count_if(F.col("a_prediction") == F.col("b_prediction"))
    total = F.count(F.lit(1))
    return left.join(right, key).agg(
        same.alias("agree"),
        total.alias("total"),
        F.try_divide(same, total).alias("rate"),
        F.max(delta).alias("max_delta"),
    )
