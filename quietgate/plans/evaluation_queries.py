"""Evaluation, calibration and comparison queries over scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import evaluation as ev
from ..operators import joins, scorer, windows
from .catalog import Catalog

CATALOG = Catalog()

GATES = {"allow": 0.7, "block": 0.65}
_SUMMARY = """count(*) AS n, count_if(gold = prediction) AS correct, count_if(gold = prediction) / count(*) AS accuracy,
  count_if(gold = 'match' AND prediction = 'no_match') AS match_to_no_match,
  count_if(gold = 'insufficient' AND prediction = 'no_match') AS insufficient_to_no_match,
  count_if(gold = 'no_match' AND prediction = 'match') AS no_match_to_match,
  count_if(gold = 'match' AND prediction = 'no_match') / nullif(count_if(gold = 'match'), 0) AS sensitive_miss_rate"""
_BEST = """CASE WHEN p_match >= p_no_match AND p_match >= p_insufficient THEN 'match'
  WHEN p_no_match >= p_insufficient THEN 'no_match' ELSE 'insufficient' END"""


def route_sql(allow: str, block: str) -> str:
    return f"""CASE WHEN ({_BEST}) = 'match' AND p_match >= {block} THEN 'block'
      WHEN ({_BEST}) = 'no_match' AND p_no_match >= {allow} THEN 'allow' ELSE 'review' END"""


def actions_sql(action: str) -> str:
    pair = lambda g, a: f"count_if(gold = '{g}' AND {action} = '{a}')"
    return f"""count(*) AS rows, count_if({action} = 'block') AS block, count_if({action} = 'allow') AS allow,
      count_if({action} = 'review') AS review, {pair('match', 'allow')} AS sensitive_allowed,
      {pair('insufficient', 'allow')} AS ambiguous_allowed, {pair('no_match', 'block')} AS safe_blocked,
      {pair('insufficient', 'block')} AS ambiguous_blocked, {pair('no_match', 'allow')} AS safe_allowed,
      {pair('match', 'block')} AS sensitive_blocked"""


_ROUTED = f"SELECT *, {route_sql('0.7', '0.65')} AS action FROM preds"


@CATALOG.add("preds", sql=f"SELECT {_SUMMARY} FROM preds")
def summarize(preds):
    return agg.summarize(preds)


@CATALOG.add(
    "preds",
    sql="""WITH l AS (SELECT unnest(['match', 'no_match', 'insufficient']) AS label)
    SELECT a.label AS gold, b.label AS prediction, count(p.id) AS n FROM l a CROSS JOIN l b
    LEFT JOIN preds p ON p.gold = a.label AND p.prediction = b.label GROUP BY 1, 2""",
)
def confusion(preds):
    return agg.confusion(preds)


@CATALOG.add(
    "preds",
    sql=" UNION ALL ".join(
        f"SELECT '{k}' AS slice, {k} AS value, {_SUMMARY} FROM preds GROUP BY {k}"
        for k in ("language", "policy_language", "policy_id")
    )
    + f" UNION ALL SELECT 'all', NULL, {_SUMMARY} FROM preds",
)
def slices(preds):
    return agg.slices(preds)


def with_tags(preds):
    return preds.withColumn(
        "tags",
        F.when(F.col("tag_list") == "", F.array().cast("array<string>")).otherwise(
            F.split("tag_list", ",")
        ),
    )


@CATALOG.add(
    "preds",
    sql=f"""SELECT tag, {_SUMMARY} FROM (SELECT *, unnest(string_split(tag_list, ',')) AS tag FROM preds WHERE tag_list <> '') t GROUP BY tag""",
)
def tag_slices(preds):
    return agg.tag_slices(with_tags(preds))


@CATALOG.add("preds", sql=f"SELECT {actions_sql('action')} FROM ({_ROUTED}) r")
def action_counts(preds):
    return agg.action_counts(preds, GATES)


@CATALOG.add("preds", sql=f"SELECT id, action FROM ({_ROUTED}) r")
def route(preds):
    return ev.route(preds, GATES).select("id", "action")


@CATALOG.add(
    "runs",
    sql="""WITH s AS (SELECT model, condition, list_sort(list(latency_ms)) AS l FROM runs GROUP BY ALL)
    SELECT model, condition, len(l) AS n, (l[cast(floor((len(l) - 1) / 2.0) as int) + 1] + l[cast(floor(len(l) / 2.0) as int) + 1]) / 2 AS p50,
      l[cast(floor((len(l) - 1) * cast(0.95 as double)) as int) + 1] AS p95 FROM s""",
)
def latency_summary(runs):
    return agg.latency_summary(runs, ["model", "condition"])


@CATALOG.add(
    "runs",
    sql="""SELECT model, count(*) AS n, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95 FROM runs GROUP BY model""",
)
def latency_linear(runs):
    out = agg.latency_linear(runs, ["model"])
    return out.select("model", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@CATALOG.add(
    "gold",
    sql="""SELECT split, count(*) AS rows, min(tokens) AS min_tokens, max(tokens) AS max_tokens, round(avg(tokens), 6) AS mean_tokens FROM gold GROUP BY split""",
)
def token_audit(rows):
    out = agg.token_audit(rows, ["split"])
    return out.withColumn("mean_tokens", F.round("mean_tokens", 6))


_OWN = "CASE prediction WHEN 'match' THEN p_match WHEN 'no_match' THEN p_no_match ELSE p_insufficient END"


@CATALOG.add(
    "preds",
    sql=f"""WITH r AS (SELECT prediction AS label, {_OWN} AS score, gold = prediction AS good FROM preds WHERE prediction <> 'insufficient'),
    w AS (SELECT l.label, coalesce(max(score), 0) AS top FROM (SELECT unnest(['match', 'no_match']) AS label) l
      LEFT JOIN r ON r.label = l.label AND NOT good GROUP BY l.label)
    SELECT w.label, w.top AS highest_wrong, coalesce(round(median(score), 9), 0) AS median_right, count_if(score > w.top) AS right_above
    FROM w LEFT JOIN r ON r.label = w.label AND good GROUP BY w.label, w.top""",
)
def margin_diagnostic(preds):
    return agg.margin_diagnostic(preds).withColumn("median_right", F.round("median_right", 9))


@CATALOG.add(
    "runs",
    sql="""SELECT model, max(latency_ms) AS peak_latency_ms, min(tokens) AS min_tokens, max(tokens) AS max_tokens FROM runs GROUP BY model""",
)
def resource_peak(runs):
    return agg.resource_peak(runs, ["model"], ["latency_ms"], "tokens")


@CATALOG.add(
    "preds", "cand",
    sql="""SELECT count_if(a.prediction = b.prediction) AS agree, count(*) AS total, count_if(a.prediction = b.prediction) / count(*) AS rate,
      max(greatest(abs(a.p_match - b.p_match), abs(a.p_no_match - b.p_no_match), abs(a.p_insufficient - b.p_insufficient))) AS max_delta
    FROM preds a JOIN cand b ON a.id = b.id""",
)
def agreement(preds, cand):
    return agg.agreement(preds, cand)


@CATALOG.add(
    "preds", "gold",
    sql="""WITH a AS (SELECT id, count(*) AS p FROM preds WHERE status = 200 GROUP BY id), b AS (SELECT id, count(*) AS e FROM gold GROUP BY id)
    SELECT cast(sum(p) as bigint) AS predicted, cast(sum(e) as bigint) AS expected, count_if(p IS NULL) AS missing, count_if(e IS NULL) AS unexpected,
      count_if(p > 1) AS repeated, count_if(p IS NULL OR e IS NULL OR p > 1) = 0 AND sum(p) = sum(e) AS covered
    FROM a FULL JOIN b ON a.id = b.id""",
)
def id_coverage(preds, gold):
    # A failed request leaves no prediction.
    return joins.id_coverage(preds.filter("status = 200"), gold)


@CATALOG.add(
    "preds", "cand",
    sql="""SELECT a.id, b.gold, a.prediction AS base_prediction, b.prediction AS cand_prediction FROM preds a JOIN cand b ON a.id = b.id""",
)
def paired_predictions(preds, cand):
    return joins.paired_predictions(preds, cand)


@CATALOG.add(
    "preds",
    sql=f"""WITH p AS (SELECT id, gold, source_family, prediction,
        CASE WHEN id % 40 = 1 THEN cast('NaN' as double) WHEN id % 40 = 2 THEN p_match + 0.5 ELSE p_match END AS p_match,
        p_no_match, p_insufficient FROM preds)
    SELECT id, CASE WHEN isnan(p_match) OR p_match NOT BETWEEN 0 AND 1 THEN 'invalid_probabilities'
      WHEN abs(p_match + p_no_match + p_insufficient - 1) > 0.00001 THEN 'probabilities_must_sum_to_one'
      WHEN prediction <> ({_BEST}) THEN 'prediction_does_not_match_scores' END AS problem FROM p
    WHERE problem IS NOT NULL""",
)
def validate_scores(preds):
    spoiled = preds.withColumn(
        "p_match",
        F.when(F.col("id") % 40 == 1, F.lit(float("nan")))
        .when(F.col("id") % 40 == 2, F.col("p_match") + 0.5)
        .otherwise(F.col("p_match")),
    )
    return ev.validate_scores(spoiled)




def _min_above(candidates: list[float], wrong: str) -> str:
    """Lowest candidate above a bound, as nested CASE (candidates ascend)."""
    out = "NULL"
    for c in reversed(candidates):
        out = f"CASE WHEN {wrong} IS NULL OR {wrong} < cast({c} as double) THEN cast({c} as double) ELSE {out} END"
    return out


_WRONG = {
    "allow": "max(CASE WHEN prediction = 'no_match' AND gold <> 'no_match' THEN p_no_match END)",
    "block": "max(CASE WHEN prediction = 'match' AND gold <> 'match' THEN p_match END)",
}


@CATALOG.add(
    "preds",
    sql=f"""WITH c AS (SELECT unnest({ev.COARSE}) AS t),
    ok AS (SELECT t, count_if(prediction = 'no_match' AND p_no_match >= t AND gold <> 'no_match') AS a,
        count_if(prediction = 'match' AND p_match >= t AND gold <> 'match') AS b FROM c CROSS JOIN preds GROUP BY t)
    SELECT cast(min(CASE WHEN a = 0 THEN t END) as double) AS allow, cast(min(CASE WHEN b = 0 THEN t END) as double) AS block FROM ok""",
)
def calibrate_coarse(preds):
    return ev.calibrate_coarse(preds)


def fine_sql(source: str, key: str = "") -> str:
    """Fine gates of ``source``; ``key`` lists grouping columns."""
    k, by = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    using = f"USING ({key})" if key else "ON true"
    half = lambda w: f"greatest(0.5, (floor(coalesce({w}, 0) * 10000) + 1) / 10000)"
    return f"""SELECT {k}CASE WHEN na < 3 THEN 1.0001 ELSE ta END AS allow, CASE WHEN nb < 3 THEN 1.0001 ELSE tb END AS block FROM (
      SELECT {k}max(ta) AS ta, max(tb) AS tb, count(DISTINCT CASE WHEN prediction = 'no_match' AND p_no_match >= ta THEN source_family END) AS na,
        count(DISTINCT CASE WHEN prediction = 'match' AND p_match >= tb THEN source_family END) AS nb
      FROM ({source}) s JOIN (SELECT {k}{half(_WRONG['allow'])} AS ta, {half(_WRONG['block'])} AS tb FROM ({source}) s {by}) w {using} {by}) g"""


@CATALOG.add(
    "preds",
    sql=f"SELECT cast(allow as double) AS allow, cast(block as double) AS block FROM ({fine_sql('SELECT * FROM preds')}) f",
)
def fine_gates(preds):
    return ev.fine_gates(preds)


_THRESHOLDS = f"""WITH c AS (SELECT unnest({ev.PER_POLICY}) AS t),
    tried AS (SELECT policy_id, t, count_if(prediction <> 'insufficient' AND ({_OWN}) >= t) AS accepted,
        count_if(prediction <> 'insufficient' AND ({_OWN}) >= t AND gold <> prediction) AS bad FROM preds CROSS JOIN c GROUP BY ALL),
    best AS (SELECT policy_id, t FROM tried WHERE accepted > 0 AND bad = 0 QUALIFY row_number() OVER (PARTITION BY policy_id ORDER BY accepted DESC, t) = 1),
    th AS (SELECT p.policy_id, cast(coalesce(best.t, 0.999) as double) AS threshold FROM (SELECT DISTINCT policy_id FROM preds) p LEFT JOIN best ON best.policy_id = p.policy_id)
    """
_EFFECTIVE = """SELECT p.*, CASE WHEN prediction = 'insufficient' OR greatest(p_match, p_no_match, p_insufficient) < threshold THEN 'review'
      WHEN prediction = 'match' THEN 'block' ELSE 'allow' END AS effective FROM preds p JOIN th ON th.policy_id = p.policy_id"""


@CATALOG.add("preds", sql=_THRESHOLDS + "SELECT * FROM th")
def policy_thresholds(preds):
    return ev.policy_thresholds(preds)


@CATALOG.add("preds", sql=_THRESHOLDS + f"SELECT id, effective FROM ({_EFFECTIVE}) e")
def effective_policy_route(preds):
    return ev.effective_policy_route(preds, ev.policy_thresholds(preds)).select("id", "effective")


@CATALOG.add(
    "preds",
    sql=_THRESHOLDS
    + f""", e AS ({_EFFECTIVE})
    SELECT coalesce(language, 'all') AS "group", count(*) AS n, count_if(gold = prediction) AS raw_correct,
      count_if(gold = 'match' AND effective = 'allow') AS false_allow, count_if(gold = 'no_match' AND effective = 'block') AS false_block,
      count_if(effective = 'review') AS reviews, count_if(gold = 'no_match' AND effective = 'allow') AS safe_allow,
      count_if(gold = 'match') AS sensitive_count, count_if(gold = 'no_match') AS safe_count FROM e GROUP BY ROLLUP (language)""",
)
def heldout_summary(preds):
    return ev.heldout_summary(ev.effective_policy_route(preds, ev.policy_thresholds(preds)))


_FOLDS = """SELECT source_family, cast((row_number() OVER (ORDER BY md5('20261003:' || source_family)) - 1) % 6 as int) AS fold
    FROM (SELECT DISTINCT source_family FROM preds) f"""


@CATALOG.add("preds", sql=_FOLDS)
def family_folds(preds):
    return ev.family_folds(preds)


_FIT = f"""SELECT h.fold AS held, p.* FROM preds p JOIN ({_FOLDS}) f ON f.source_family = p.source_family
    JOIN (SELECT unnest(range(0, 6)) AS fold) h ON h.fold <> f.fold"""


def _cross_sql(gates: str) -> str:
    return f"""SELECT cast(f.fold as int) AS fold, cast(g.allow as double) AS gate_allow, cast(g.block as double) AS gate_block, {actions_sql('action')}
    FROM (SELECT p.*, f.fold, {route_sql('g.allow', 'g.block')} AS action, g.allow, g.block FROM preds p
      JOIN ({_FOLDS}) f ON f.source_family = p.source_family JOIN ({gates}) g ON g.held = f.fold) f
    JOIN ({gates}) g ON g.held = f.fold GROUP BY ALL"""


_FINE_FOLDS = fine_sql(_FIT, "held")
_COARSE_FOLDS = f"""SELECT held, {_min_above(ev.COARSE, 'wa')} AS allow, {_min_above(ev.COARSE, 'wb')} AS block
    FROM (SELECT held, {_WRONG['allow']} AS wa, {_WRONG['block']} AS wb FROM ({_FIT}) x GROUP BY held) y"""


@CATALOG.add("preds", sql=_cross_sql(_FINE_FOLDS))
def cross_validate(preds):
    return ev.cross_validate(preds, "fine")


@CATALOG.add("preds", sql=_cross_sql(_COARSE_FOLDS))
def cross_validate_coarse(preds):
    return ev.cross_validate(preds, "coarse")


SWEEP = [0.5, 0.7, 0.8, 0.9, 0.95, 0.97, 0.99]


@CATALOG.add(
    "preds",
    sql=f"""SELECT threshold, {actions_sql('action')} FROM (
      SELECT p.*, t.threshold, {route_sql('t.threshold', 't.threshold')} AS action
      FROM preds p CROSS JOIN (SELECT cast(unnest({SWEEP}) as double) AS threshold) t) x GROUP BY threshold""",
)
def threshold_sweep(preds):
    out = ev.threshold_sweep(preds, SWEEP)
    return out.select(*[F.col(c) for c in out.columns])


_CHANGE = """count(*) AS n, count_if(a.prediction <> b.gold AND b.prediction = b.gold) AS rescued,
      count_if(a.prediction = b.gold AND b.prediction <> b.gold) AS regressed,
      count_if(a.prediction <> b.gold AND b.prediction <> b.gold) AS both_wrong, count_if(a.prediction <> b.prediction) AS changed,
      100 * (count_if(b.prediction = b.gold) - count_if(a.prediction = b.gold)) / count(*) AS accuracy_delta_pp"""


@CATALOG.add("preds", "cand", sql=f"SELECT {_CHANGE} FROM preds a JOIN cand b ON a.id = b.id")
def paired_change(preds, cand):
    return ev.paired_change(preds, cand)


_TWO = f"""SELECT b.gold, b.prediction, b.id, a.action AS first, CASE WHEN a.action <> 'review' THEN a.action ELSE b.action END AS action
    FROM ({_ROUTED}) a JOIN (SELECT *, {route_sql('0.6', '0.6')} AS action FROM rival) b ON a.id = b.id"""


@CATALOG.add("preds", "rival", sql=f"SELECT {actions_sql('action')} FROM ({_TWO}) t")
def cascade(preds, rival):
    return ev.cascade(preds, GATES, rival, {"allow": 0.6, "block": 0.6})


@CATALOG.add("preds", "rival", sql=f"SELECT {_SUMMARY} FROM ({_TWO}) t WHERE first = 'review'")
def review_subset(preds, rival):
    return ev.review_subset(preds, GATES, rival)


def _side(alias: str, table: str) -> str:
    return f"""{alias} AS (SELECT t.*, l.legacy_accuracy, l.legacy_sensitive, l.legacy_ambiguous FROM
      (SELECT count_if(gold = prediction) / count(*) AS accuracy, {actions_sql('action')} FROM (SELECT *, {route_sql('0.7', '0.65')} AS action FROM {table} WHERE split = 'test') r) t,
      (SELECT count_if(gold = prediction) / count(*) AS legacy_accuracy, count_if(gold = 'match' AND action = 'allow') AS legacy_sensitive,
        count_if(gold = 'insufficient' AND action = 'allow') AS legacy_ambiguous
       FROM (SELECT *, {route_sql('0.7', '0.65')} AS action FROM {table} WHERE split <> 'test') r) l)"""


@CATALOG.add(
    "preds", "cand",
    sql=f"""WITH {_side('b', 'preds')}, {_side('c', 'cand')},
    g AS (SELECT c.accuracy >= b.accuracy + 0.02 AS g1, c.sensitive_allowed = 0 AS g2, c.ambiguous_allowed = 0 AS g3, c.safe_blocked <= b.safe_blocked AS g4,
      c.safe_allowed + c.sensitive_blocked >= b.safe_allowed + b.sensitive_blocked AS g5, c.legacy_accuracy >= b.legacy_accuracy AS g6,
      c.legacy_sensitive = 0 AND c.legacy_ambiguous = 0 AS g7 FROM b, c)
    SELECT unnest(['raw_accuracy_improves_two_points', 'no_sensitive_allow', 'no_ambiguous_allow', 'no_added_safe_block', 'correct_automation_maintained',
      'legacy_accuracy_maintained', 'legacy_no_sensitive_or_ambiguous_allow', 'accepted']) AS gate,
      unnest([g1, g2, g3, g4, g5, g6, g7, g1 AND g2 AND g3 AND g4 AND g5 AND g6 AND g7]) AS passed FROM g""",
)
def acceptance_gates(preds, cand):
    side = lambda df: ev.acceptance_summary(
        df.filter("split = 'test'"), df.filter("split <> 'test'"), GATES
    )
    return ev.acceptance_gates(side(preds), side(cand))


_RUN_GATES = fine_sql("SELECT * FROM runs WHERE split = 'calibration'", "model, condition")


@CATALOG.add(
    "runs",
    sql=f"SELECT model, condition, cast(allow as double) AS allow, cast(block as double) AS block FROM ({_RUN_GATES}) g",
)
def run_gates(runs):
    return ev.run_gates(runs)


@CATALOG.add(
    "runs",
    sql=f"""WITH g AS ({_RUN_GATES}), t AS (SELECT r.*, cast(g.allow as double) AS ga, cast(g.block as double) AS gb, {route_sql('g.allow', 'g.block')} AS action
        FROM runs r JOIN g ON g.model = r.model AND g.condition = r.condition WHERE split = 'test'),
    q AS (SELECT model, condition, {_SUMMARY}, max(ga) AS gate_allow, max(gb) AS gate_block, {actions_sql('action').replace('count(*) AS rows, ', '')},
      count_if(language = 'ko' AND gold = prediction) / nullif(count_if(language = 'ko'), 0) AS accuracy_ko,
      count_if(language = 'en' AND gold = prediction) / nullif(count_if(language = 'en'), 0) AS accuracy_en FROM t GROUP BY model, condition),
    s AS (SELECT model, condition, list_sort(list(latency_ms)) AS l FROM t GROUP BY ALL),
    lat AS (SELECT model, condition, (l[cast(floor((len(l) - 1) / 2.0) as int) + 1] + l[cast(floor(len(l) / 2.0) as int) + 1]) / 2 AS p50_ms,
      l[cast(floor((len(l) - 1) * cast(0.95 as double)) as int) + 1] AS p95_ms FROM s),
    c AS (SELECT b.model, b.condition, {_CHANGE} FROM t b JOIN t a ON a.id = b.id AND a.model = b.model AND a.condition = 'original' GROUP BY b.model, b.condition)
    SELECT q.*, lat.p50_ms, lat.p95_ms, c.rescued, c.regressed, c.both_wrong, c.changed, c.accuracy_delta_pp
    FROM q LEFT JOIN lat USING (model, condition) LEFT JOIN c USING (model, condition)""",
)
def leaderboard(runs):
    return ev.leaderboard(runs)


@CATALOG.add(
    "preds",
    sql=f"SELECT id, policy_id, gold, prediction, action AS recommended_action, false AS enforcement_performed FROM ({_ROUTED}) r",
)
def replay(preds):
    return ev.replay(preds, GATES)


@CATALOG.add(
    "preds", "rival",
    sql=f"""SELECT 'canonical' AS option_order, {_SUMMARY} FROM preds UNION ALL SELECT 'permuted', {_SUMMARY} FROM rival""",
)
def order_robustness(preds, rival):
    return ev.order_robustness(preds, rival)


@CATALOG.add(
    "runs",
    sql="""SELECT problem, count(*) AS rows FROM (SELECT CASE WHEN model <> 'alpha' THEN 'model_revision_mismatch'
      WHEN condition <> 'original' THEN 'policies_hash_mismatch' END AS problem FROM runs) x WHERE problem IS NOT NULL GROUP BY problem
    UNION ALL SELECT 'threshold_out_of_range', 0""",
)
def profile_binding(runs):
    scored = runs.withColumn("model_revision", F.col("model")).withColumn(
        "policies_hash", F.col("condition")
    )
    first = scored.agg(
        F.min("model_revision").alias("model_revision"), F.max("policies_hash").alias("policies_hash")
    )
    profile = first.select(
        "model_revision", "policies_hash", F.lit(0.9).alias("allow"), F.lit(1.5).alias("block")
    )
    bound = ev.profile_binding(profile, scored)
    return bound.groupBy("problem").agg(F.sum("rows").alias("rows"))


@CATALOG.add(
    "runs",
    sql="""WITH s AS (SELECT model AS "group", list_sort(list(latency_ms)) AS l, list_sort(list(latency_ms) FILTER (WHERE status = 200)) AS k FROM runs GROUP BY model)
    SELECT "group", len(l) AS n, (l[cast(floor((len(l) - 1) / 2.0) as int) + 1] + l[cast(floor(len(l) / 2.0) as int) + 1]) / 2 AS p50,
      l[cast(floor((len(l) - 1) * cast(0.95 as double)) as int) + 1] AS p95, len(k) AS success,
      k[cast(floor((len(k) - 1) * cast(0.95 as double)) as int) + 1] AS p95_ok, len(l) - len(k) AS errors FROM s""",
)
def probe_groups(runs):
    return ev.probe_groups(
        runs.select(F.col("model").alias("group"), F.col("latency_ms").alias("ms"), "status")
    )


@CATALOG.add(
    "runs",
    sql="""SELECT count(*) AS n, count_if(ok) AS success FROM (SELECT id, bool_and(status = 200) AS ok FROM runs GROUP BY id) x""",
)
def multi_request(runs):
    # Three requests per row id: the list is bounded by the number of runs.
    return ev.multi_request(runs.groupBy("id").agg(F.collect_list("status").alias("statuses")))


@CATALOG.add(
    "preds",
    sql="""WITH s AS (SELECT policy_id AS model, cast(substr(source_family, 4) as bigint) AS step, count_if(gold = prediction) / count(*) AS accuracy FROM preds GROUP BY ALL)
    SELECT model, arg_max(step, {'a': accuracy, 's': -step}) AS best_step, max(accuracy) AS best_accuracy, max(step) AS latest_step,
      arg_max(accuracy, step) AS latest_accuracy FROM s GROUP BY model""",
)
def best_checkpoint(preds):
    log = preds.groupBy(
        F.col("policy_id").alias("model"), F.substring("source_family", 4, 9).cast("long").alias("step")
    ).agg((F.count_if(F.col("gold") == F.col("prediction")) / F.count(F.lit(1))).alias("accuracy"))
    return windows.best_checkpoint(log)


def _sound(scored):
    """What must hold for any model: scores are probabilities and the prediction is their maximum."""
    p = [F.col(f"p_{x}") for x in ("match", "no_match", "insufficient")]
    return [
        ((F.abs(p[0] + p[1] + p[2] - 1) < 1e-9) & (F.least(*p) >= 0)).alias("sums_to_one"),
        F.coalesce(
            F.element_at(F.create_map(F.lit("match"), p[0], F.lit("no_match"), p[1], F.lit("insufficient"), p[2]), F.col("prediction"))
            == F.greatest(*p), F.lit(False),
        ).alias("is_maximum"),
    ]


@CATALOG.add(
    "corpus",
    sql="""SELECT id, split, gold, true AS sums_to_one, true AS is_maximum, true AS gates_in_range FROM corpus WHERE split = 'test'""",
)
def train_scorer(rows):
    """Train, choose and score with Spark ML at the operator's own settings.

    Floating point differs between engines, so SQL checks the rows and what any model must keep.
    """
    fitted = scorer.train_scorer(rows.select("id", "split", "gold", "text", "source_family"))
    allow, block = fitted["gates"].select("allow", "block").first()
    ranged = all(g is not None and 0.5 <= g <= 1.001 for g in (allow, block))
    test = fitted["test"]
    return test.select("id", "split", "gold", *_sound(test), F.lit(ranged).alias("gates_in_range"))


@CATALOG.add(
    "corpus", sql="SELECT id, gold, true AS sums_to_one, true AS is_maximum FROM corpus",
)
def score_documents(rows):
    model = scorer.fit_scorer(rows.filter("split = 'train'"))
    scored = scorer.score_documents(rows.select("id", "gold", "text"), model)
    return scored.select("id", "gold", *_sound(scored))
