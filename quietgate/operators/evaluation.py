"""Score validation, gate calibration, cross-validation and model comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import running
from ..functions.scores import (
    DISABLED,
    LABELS,
    P,
    best_label,
    best_score,
    gate,
    routed,
    score_of,
)
from .aggregates import (
    action_columns,
    latency_summary,
    summarize,
    summary_columns,
)
from .joins import paired_predictions

# Candidate gates of the coarse rule and of the per-policy rule.
COARSE = [0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.97, 0.99, 0.995, 0.999, 1.000001]
PER_POLICY = [0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98, 0.99]
PER_POLICY_DEFAULT = 0.999

# The label each automatic action stands for.
ACTIONS = {"allow": "no_match", "block": "match"}


def row_problem(tol: float = 1e-5) -> Column:
    scores = [F.col(P[x]) for x in LABELS]
    bad = F.lit(False)
    for s in scores:
        bad = bad | s.isNull() | F.isnan(s) | ~s.between(0, 1)
    return (
        F.when(~F.coalesce(F.col("gold").isin(*LABELS), F.lit(False)), "invalid_labels")
        .when(bad, "invalid_probabilities")
        .when(F.abs(scores[0] + scores[1] + scores[2] - 1) > tol, "probabilities_must_sum_to_one")
        .when(~F.col("prediction").eqNullSafe(best_label()), "prediction_does_not_match_scores")
        .when(F.coalesce(F.col("source_family"), F.lit("")) == "", "missing_source_family")
    )


def validate_scores(preds: DataFrame, tol: float = 1e-5) -> DataFrame:
    """Violations ``(id, problem)``: bad rows, repeated ids, and an entry for an empty input."""
    # Tested after an explode: a pushed-down filter would evaluate every check twice.
    rows = preds.select(
        "id", F.explode_outer(F.array(row_problem(tol))).alias("problem")
    ).filter("problem is not null")
    repeated = (
        preds.groupBy("id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("id", F.lit("duplicate_id").alias("problem"))
    )
    empty = (
        preds.agg(F.count(F.lit(1)).alias("n"))
        .filter("n = 0")
        .select(
            F.lit(None).cast(preds.schema["id"].dataType).alias("id"),
            F.lit("empty").alias("problem"),
        )
    )
    return rows.unionByName(repeated).unionByName(empty)


def route(preds: DataFrame, gates: DataFrame | dict) -> DataFrame:
    return preds.withColumn("action", routed(gate(gates, "allow"), gate(gates, "block")))


def _first_above(candidates: Sequence[float], bound: Column) -> Column:
    """Smallest candidate above ``bound``; the first one when there is nothing to exceed."""
    out = F.lit(None).cast("double")
    for c in reversed(candidates):
        out = F.when(bound.isNull() | (bound < c), F.lit(float(c))).otherwise(out)
    return out


def _wrong(label: str) -> Column:
    """Score of rows predicted ``label`` although it is not the gold label."""
    return F.when(
        (F.col("prediction") == label) & (F.col("gold") != label), F.col(P[label])
    )


def calibrate_coarse(preds: DataFrame) -> DataFrame:
    """Per action the smallest candidate gate that accepts no wrong row.

    "No wrong row reaches t" is "t exceeds the highest wrong score", so one maximum per action
    replaces trying every candidate on every row. With nothing wrong the gate is the lowest.
    """
    tops = preds.agg(*[F.max(_wrong(label)).alias(a) for a, label in ACTIONS.items()])
    return tops.select(*[_first_above(COARSE, F.col(a)).alias(a) for a in ACTIONS])


def _fine_threshold(top_wrong: Column) -> Column:
    """Next 1e-4 step above the highest wrong score, at least one half."""
    return F.greatest(
        F.lit(0.5), (F.floor(F.coalesce(top_wrong, F.lit(0.0)) * 10000) + 1) / F.lit(10000.0)
    )


def _family_tops(preds: DataFrame, *extra: str) -> DataFrame:
    """Per family: highest accepted-side score and highest wrong score of each action."""
    return preds.groupBy("source_family", *extra).agg(
        *[
            F.max(F.when(F.col("prediction") == label, F.col(P[label]))).alias(f"top_{a}")
            for a, label in ACTIONS.items()
        ],
        *[F.max(_wrong(label)).alias(f"wrong_{a}") for a, label in ACTIONS.items()],
    )


def fine_gates(preds: DataFrame, min_families: int = 3) -> DataFrame:
    """Gates just above the highest observed error; an action needs family support.

    One shuffle by family: a family supports a gate exactly when its best score reaches it.
    """
    tops = _family_tops(preds)
    limits = tops.agg(
        *[_fine_threshold(F.max(f"wrong_{a}")).alias(f"t_{a}") for a in ACTIONS]
    )
    support = tops.join(F.broadcast(limits)).agg(
        *[F.first(f"t_{a}").alias(f"t_{a}") for a in ACTIONS],
        *[F.count_if(F.col(f"top_{a}") >= F.col(f"t_{a}")).alias(f"n_{a}") for a in ACTIONS],
    )
    return support.select(
        *[
            F.when(F.col(f"n_{a}") < min_families, F.lit(DISABLED))
            .otherwise(F.coalesce(F.col(f"t_{a}"), F.lit(DISABLED)))
            .alias(a)
            for a in ACTIONS
        ]
    )


def policy_thresholds(preds: DataFrame) -> DataFrame:
    """Per policy the candidate accepting most rows while every accepted row is right.

    Accepting more means the lowest valid candidate; it must accept at least one row, otherwise
    the policy keeps the default.
    """
    sure = F.col("prediction") != "insufficient"
    own = score_of(F.col("prediction"))
    tops = preds.groupBy("policy_id").agg(
        F.max(F.when(sure & (F.col("prediction") != F.col("gold")), own)).alias("_wrong"),
        F.max(F.when(sure, own)).alias("_top"),
    )
    t = _first_above(PER_POLICY, F.col("_wrong"))
    return tops.select(
        "policy_id",
        F.when(F.col("_top") >= t, t).otherwise(F.lit(PER_POLICY_DEFAULT)).alias("threshold"),
    )


def effective_policy_route(preds: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Add ``effective`` under each policy's own threshold; missing scores go to review."""
    t = F.coalesce("threshold", F.lit(PER_POLICY_DEFAULT))
    doubt = (
        F.col("prediction").isNull()
        | best_score().isNull()
        | (F.col("prediction") == "insufficient")
        | (best_score() < t)
    )
    return (
        preds.join(thresholds, "policy_id", "left")
        .withColumn(
            "effective",
            F.when(doubt, "review")
            .when(F.col("prediction") == "match", "block")
            .otherwise("allow"),
        )
        .drop("threshold")
    )


def heldout_summary(routed_rows: DataFrame) -> DataFrame:
    """Held-out counts for each language and for all, in one pass."""
    gold, eff = F.col("gold"), F.col("effective")
    grouped = routed_rows.rollup("language").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(gold == F.col("prediction")).alias("raw_correct"),
        F.count_if((gold == "match") & (eff == "allow")).alias("false_allow"),
        F.count_if((gold == "no_match") & (eff == "block")).alias("false_block"),
        F.count_if(eff == "review").alias("reviews"),
        F.count_if((gold == "no_match") & (eff == "allow")).alias("safe_allow"),
        F.count_if(gold == "match").alias("sensitive_count"),
        F.count_if(gold == "no_match").alias("safe_count"),
        F.grouping("language").alias("_all"),
    )
    return grouped.withColumn(
        "group", F.when(F.col("_all") == 1, "all").otherwise(F.col("language"))
    ).drop("_all", "language")


def family_key(family: Column, seed: int = 20261003) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), family))


def family_folds(preds: DataFrame, k: int = 6) -> DataFrame:
    """``(source_family, fold)``: families in hash order dealt round-robin, so folds are even.

    Ranks come from chunks by hash prefix, so the family list is never sorted in one task. Fewer
    families than folds are an error: some fold would hold nothing.
    """
    named = preds.select("source_family").distinct()
    several = named.agg(F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("n") >= k, F.lit(True)).otherwise(F.raise_error(F.lit("too few source families")).cast("boolean"))
    )
    families = named.filter(several.scalar()).withColumn("_key", family_key(F.col("source_family")))
    ranked = running(
        families, [], ["_key"], F.substring("_key", 1, 2), {"_rn": ("sum", F.lit(1))}
    )
    return ranked.select("source_family", ((F.col("_rn") - 1) % k).cast("int").alias("fold"))


def cross_validate(
    preds: DataFrame, selector: str = "fine", k: int = 6, min_families: int = 3
) -> DataFrame:
    """Per fold: gates fitted on the other folds and the actions they take on the held rows.

    Fitting needs only each family's best and worst scores. A fold's bound is the largest over
    the other folds, read from k rows; support is counted per fold over families. Rows are
    visited once, and no fold is trained in a driver loop.
    """
    folds = family_folds(preds, k)
    tops = _family_tops(preds).join(folds, "source_family")
    per_fold = tops.groupBy("fold").agg(*[F.max(f"wrong_{a}").alias(f"w_{a}") for a in ACTIONS])
    held_out = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold")))
    limits = (
        per_fold.select(held_out.alias("held"), *[f"w_{a}" for a in ACTIONS])
        .groupBy("held")
        .agg(*[F.max(f"w_{a}").alias(f"w_{a}") for a in ACTIONS])
    )
    if selector == "coarse":
        gates = limits.select(
            "held", *[_first_above(COARSE, F.col(f"w_{a}")).alias(a) for a in ACTIONS]
        )
    else:
        limits = limits.select(
            "held", *[_fine_threshold(F.col(f"w_{a}")).alias(f"t_{a}") for a in ACTIONS]
        )
        gates = (
            tops.select(held_out.alias("held"), *[f"top_{a}" for a in ACTIONS])
            .join(F.broadcast(limits), "held")  # k rows
            .groupBy("held")
            .agg(
                *[F.first(f"t_{a}").alias(f"t_{a}") for a in ACTIONS],
                *[
                    F.count_if(F.col(f"top_{a}") >= F.col(f"t_{a}")).alias(f"n_{a}")
                    for a in ACTIONS
                ],
            )
            .select(
                "held",
                *[
                    F.when(F.col(f"n_{a}") < min_families, F.lit(DISABLED))
                    .otherwise(F.col(f"t_{a}"))
                    .alias(a)
                    for a in ACTIONS
                ],
            )
        )
    rows = preds.join(folds, "source_family").join(
        F.broadcast(gates.withColumnRenamed("held", "fold")), "fold"  # k rows
    )
    acted = rows.withColumn("_action", routed(F.col("allow"), F.col("block")))
    return acted.groupBy(
        "fold", F.col("allow").alias("gate_allow"), F.col("block").alias("gate_block")
    ).agg(*action_columns(F.col("_action")))


def cross_validate_total(folds: DataFrame) -> DataFrame:
    """Action counts summed over folds."""
    counted = [c for c in folds.columns if c not in ("fold", "gate_allow", "gate_block")]
    return folds.agg(*[F.sum(c).alias(c) for c in counted])


def threshold_sweep(preds: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Action counts for equal gates at each threshold, in one pass over the rows.

    Rows are first reduced to (gold, best label, number of thresholds reached), a table whose
    size does not depend on the data; only that is expanded per threshold.
    """
    ts = sorted(float(t) for t in thresholds)
    reached = F.lit(0)
    for t in ts:
        reached = reached + (best_score() >= t).cast("int")
    small = preds.groupBy(
        "gold", best_label().alias("_best"), reached.alias("_reached")
    ).agg(F.count(F.lit(1)).alias("_n"))
    each = small.select(
        "gold",
        "_best",
        "_n",
        "_reached",
        F.posexplode(F.array(*[F.lit(t) for t in ts])).alias("_at", "threshold"),
    )
    action = (
        F.when((F.col("_reached") > F.col("_at")) & (F.col("_best") == "match"), "block")
        .when((F.col("_reached") > F.col("_at")) & (F.col("_best") == "no_match"), "allow")
        .otherwise("review")
    )
    acted = each.withColumn("_action", action)
    total = lambda cond: F.sum(F.when(cond, F.col("_n")).otherwise(0))
    gold, act = F.col("gold"), F.col("_action")
    return acted.groupBy("threshold").agg(
        F.sum("_n").alias("rows"),
        total(act == "block").alias("block"),
        total(act == "allow").alias("allow"),
        total(act == "review").alias("review"),
        total((gold == "match") & (act == "allow")).alias("sensitive_allowed"),
        total((gold == "insufficient") & (act == "allow")).alias("ambiguous_allowed"),
        total((gold == "no_match") & (act == "block")).alias("safe_blocked"),
        total((gold == "insufficient") & (act == "block")).alias("ambiguous_blocked"),
        total((gold == "no_match") & (act == "allow")).alias("safe_allowed"),
        total((gold == "match") & (act == "block")).alias("sensitive_blocked"),
    )


def _change_columns() -> list[Column]:
    base = F.col("base_prediction") == F.col("gold")
    cand = F.col("cand_prediction") == F.col("gold")
    n = F.count(F.lit(1))
    return [
        n.alias("n"),
        F.count_if(~base & cand).alias("rescued"),
        F.count_if(base & ~cand).alias("regressed"),
        F.count_if(~base & ~cand).alias("both_wrong"),
        F.count_if(F.col("base_prediction") != F.col("cand_prediction")).alias("changed"),
        F.try_divide(100 * (F.count_if(cand) - F.count_if(base)), n).alias("accuracy_delta_pp"),
    ]


def paired_change(base: DataFrame, cand: DataFrame) -> DataFrame:
    return paired_predictions(base, cand).agg(*_change_columns())


def _primary_action(primary: DataFrame, gates: DataFrame | dict) -> DataFrame:
    return route(primary, gates).select("id", F.col("action").alias("_primary"))


def cascade(
    primary: DataFrame,
    p_gates: DataFrame | dict,
    secondary: DataFrame,
    s_gates: DataFrame | dict,
) -> DataFrame:
    """Action counts when rows the primary sends to review are decided by the secondary."""
    both = _primary_action(primary, p_gates).join(route(secondary, s_gates), "id")
    action = F.when(F.col("_primary") != "review", F.col("_primary")).otherwise(F.col("action"))
    return both.withColumn("_action", action).agg(*action_columns(F.col("_action")))


def review_subset(
    primary: DataFrame, p_gates: DataFrame | dict, secondary: DataFrame
) -> DataFrame:
    """The secondary's summary on rows the primary sends to review."""
    sent = _primary_action(primary, p_gates).filter("_primary = 'review'").select("id")
    return summarize(secondary.join(sent, "id", "left_semi"))


def acceptance_gates(base: DataFrame, cand: DataFrame) -> DataFrame:
    """Seven named checks and the verdict, from one summary row per side.

    Each side is one row: accuracy, legacy_accuracy and the action counts of the test and of the
    legacy rows (``legacy_`` prefix).
    """
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    both = side(base, "b").join(side(cand, "c"))
    c, b = (lambda n: F.col(f"c_{n}")), (lambda n: F.col(f"b_{n}"))
    checks = {
        "raw_accuracy_improves_two_points": c("accuracy") >= b("accuracy") + 0.02,
        "no_sensitive_allow": c("sensitive_allowed") == 0,
        "no_ambiguous_allow": c("ambiguous_allowed") == 0,
        "no_added_safe_block": c("safe_blocked") <= b("safe_blocked"),
        "correct_automation_maintained": c("safe_allowed") + c("sensitive_blocked")
        >= b("safe_allowed") + b("sensitive_blocked"),
        "legacy_accuracy_maintained": c("legacy_accuracy") >= b("legacy_accuracy"),
        "legacy_no_sensitive_or_ambiguous_allow": (c("legacy_sensitive_allowed") == 0)
        & (c("legacy_ambiguous_allowed") == 0),
    }
    verdict = F.lit(True)
    for check in checks.values():
        verdict = verdict & check
    entries = [*checks.items(), ("accepted", verdict)]
    return both.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(k).alias("gate"), v.alias("passed")) for k, v in entries]
            )
        )
    )


def acceptance_summary(test: DataFrame, legacy: DataFrame, gates: DataFrame | dict) -> DataFrame:
    """The one-row side ``acceptance_gates`` reads."""
    accuracy = (F.count_if(F.col("gold") == F.col("prediction")) / F.count(F.lit(1)))
    main = route(test, gates).agg(
        accuracy.alias("accuracy"), *action_columns(F.col("action"))
    )
    old = route(legacy, gates).agg(
        accuracy.alias("legacy_accuracy"),
        *action_columns(F.col("action")),
    )
    renamed = old.select(
        "legacy_accuracy", *[F.col(c).alias(f"legacy_{c}") for c in old.columns if c != "legacy_accuracy"]
    )
    return main.join(renamed)


RUN = ["model", "condition"]


def run_gates(runs: DataFrame, min_families: int = 3) -> DataFrame:
    """Fine gates of every run at once, from its calibration rows."""
    tops = _family_tops(runs.filter(F.col("split") == "calibration"), *RUN)
    limits = tops.groupBy(*RUN).agg(
        *[_fine_threshold(F.max(f"wrong_{a}")).alias(f"t_{a}") for a in ACTIONS]
    )
    return (
        tops.join(limits, RUN)
        .groupBy(*RUN)
        .agg(
            *[F.first(f"t_{a}").alias(f"t_{a}") for a in ACTIONS],
            *[F.count_if(F.col(f"top_{a}") >= F.col(f"t_{a}")).alias(f"n_{a}") for a in ACTIONS],
        )
        .select(
            *RUN,
            *[
                F.when(F.col(f"n_{a}") < min_families, F.lit(DISABLED))
                .otherwise(F.col(f"t_{a}"))
                .alias(a)
                for a in ACTIONS
            ],
        )
    )


def leaderboard(runs: DataFrame, base_condition: str = "original") -> DataFrame:
    """One row per model and condition: quality, gates, actions, latency and change on its base.

    ``runs`` holds scored rows of every run with model, condition and split; gates come from
    calibration rows and everything else from test rows. A run without calibration rows has its
    gates disabled, so all it does is review.
    """
    gates = run_gates(runs)
    test = runs.filter(F.col("split") == "test")
    acted = (
        test.join(gates, RUN, "left")
        .withColumns({a: F.coalesce(a, F.lit(DISABLED)) for a in ACTIONS})
        .withColumn("_action", routed(F.col("allow"), F.col("block")))
    )
    quality = acted.groupBy(*RUN).agg(
        *summary_columns(),
        F.first("allow").alias("gate_allow"),
        F.first("block").alias("gate_block"),
        *action_columns(F.col("_action"))[1:],
        *[
            F.try_divide(
                F.count_if((F.col("language") == lang) & (F.col("gold") == F.col("prediction"))),
                F.count_if(F.col("language") == lang),
            ).alias(f"accuracy_{lang}")
            for lang in ("ko", "en")
        ],
    )
    fresh = (
        test.filter(~F.coalesce(F.col("cached"), F.lit(False))) if "cached" in runs.columns else test
    )
    latency = latency_summary(fresh, RUN).select(
        *RUN, F.col("p50").alias("p50_ms"), F.col("p95").alias("p95_ms")
    )
    base = test.filter(F.col("condition") == base_condition).select(
        "model", "id", F.col("prediction").alias("base_prediction")
    )
    change = (
        test.withColumnRenamed("prediction", "cand_prediction")
        .join(base, ["model", "id"])
        .groupBy(*RUN)
        .agg(*_change_columns()[1:])
    )
    return quality.join(latency, RUN, "left").join(change, RUN, "left")


def replay(preds: DataFrame, gates: DataFrame | dict) -> DataFrame:
    """Recommended action per row; nothing is enforced."""
    return route(preds, gates).select(
        "id",
        "policy_id",
        "gold",
        "prediction",
        F.col("action").alias("recommended_action"),
        F.lit(False).alias("enforcement_performed"),
    )


def order_robustness(canonical: DataFrame, permuted: DataFrame) -> DataFrame:
    """Summary under the canonical and under a permuted option order."""
    return summarize(
        canonical.withColumn("option_order", F.lit("canonical")).unionByName(
            permuted.withColumn("option_order", F.lit("permuted")), allowMissingColumns=True
        ),
        ["option_order"],
    )


def profile_binding(profile: DataFrame, preds: DataFrame) -> DataFrame:
    """Violations of using a gate profile on scored rows of another model or policy text.

    ``profile(model_revision, policies_hash, allow, block)`` is one row; ``preds`` carries
    model_revision and policies_hash.
    """
    seen = preds.groupBy("model_revision", "policies_hash").agg(F.count(F.lit(1)).alias("rows"))
    # Scalars: a profile of more than one row is an error, not a cross product.
    bound = seen.withColumn("_m", profile.select("model_revision").scalar()).withColumn(
        "_p", profile.select("policies_hash").scalar()
    )
    mismatch = bound.select(
        F.when(F.col("_m") != F.col("model_revision"), "model_revision_mismatch")
        .when(F.col("_p") != F.col("policies_hash"), "policies_hash_mismatch")
        .alias("problem"),
        "rows",
    ).filter("problem is not null")
    out_of_range = profile.select(
        F.explode(F.array("allow", "block")).alias("t")
    ).filter(F.col("t").isNull() | F.isnan("t") | ~F.col("t").between(0.5, DISABLED))
    return mismatch.unionByName(
        out_of_range.select(
            F.lit("threshold_out_of_range").alias("problem"), F.lit(0).cast("long").alias("rows")
        )
    )


def probe_groups(runs: DataFrame) -> DataFrame:
    """Latency per probe group over all and over successful requests, with error counts."""
    return latency_summary(
        runs.withColumn("_ok", F.col("status") == 200), ["group"], "ms", "_ok"
    ).withColumn("errors", F.col("n") - F.col("success"))


def multi_request(runs: DataFrame) -> DataFrame:
    """Multi-request runs in which every status is 200."""
    return runs.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.forall("statuses", lambda s: s == 200)).alias("success"),
    )
