import math
import random

import pytest
from pyspark.sql import functions as F

from quietgate.functions.running import order_statistics
from quietgate.operators import aggregates as agg
from quietgate.operators import evaluation as ev

SCHEMA = (
    "id string, source_family string, policy_id string, language string, policy_language string, gold string, "
    "tags array<string>, prediction string, p_match double, p_no_match double, p_insufficient double, latency_ms double"
)


def row(i, gold, label, p, family=None, policy="p", language="ko", tags=()):
    rest = (1 - p) / 2
    scores = {k: (p if k == label else rest) for k in ("match", "no_match", "insufficient")}
    return (
        str(i), family or f"f{i}", policy, language, "ko", gold, list(tags), label,
        scores["match"], scores["no_match"], scores["insufficient"], float(i),
    )


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def gates(df):
    r = df.first()
    return r.allow, r.block


def test_fine_gates_cases(spark):
    rows = [row(i, "no_match", "no_match", 0.98) for i in range(3)] + [row(3, "match", "no_match", 0.97081)]
    assert gates(ev.fine_gates(frame(spark, rows))) == (0.9709, 1.0001)
    for top in (0.98, 1.0):
        rows = [row(i, "no_match", "no_match", 0.98) for i in range(3)] + [row(3, "match", "no_match", top)]
        assert gates(ev.fine_gates(frame(spark, rows)))[0] == 1.0001
    one = [row(i, "no_match", "no_match", 0.98, family="same") for i in range(10)]
    assert gates(ev.fine_gates(frame(spark, one)))[0] == 1.0001


def test_coarse_gates_cases(spark):
    rows = [row(1, "no_match", "no_match", 0.9), row(2, "match", "no_match", 0.75), row(3, "insufficient", "insufficient", 0.9)]
    df = frame(spark, rows)
    assert gates(ev.calibrate_coarse(df)) == (0.8, 0.5)
    acts = {r.id: r.action for r in ev.route(df, ev.calibrate_coarse(df)).collect()}
    assert acts == {"1": "allow", "2": "review", "3": "review"}
    exact = frame(spark, [row(1, "match", "no_match", 0.8)])
    assert gates(ev.calibrate_coarse(exact))[0] == 0.85
    assert gates(ev.calibrate_coarse(frame(spark, [row(1, "match", "no_match", 1.0)])))[0] == 1.000001


def test_policy_thresholds(spark):
    rows = [
        row(1, "match", "match", 0.95, policy="a"), row(2, "no_match", "match", 0.7, policy="a"),
        row(3, "no_match", "match", 0.99, policy="b"), row(4, "match", "match", 0.7, policy="c"),
        row(5, "insufficient", "insufficient", 0.9, policy="d"),
    ]
    got = {r.policy_id: r.threshold for r in ev.policy_thresholds(frame(spark, rows)).collect()}
    assert got == {"a": 0.8, "b": 0.999, "c": 0.5, "d": 0.999}


@pytest.mark.parametrize("value", [math.nan, math.inf, -0.1, 1.1])
def test_bad_probabilities(spark, value):
    bad = list(row(1, "match", "match", 0.9))
    bad[8] = value
    got = [(r.id, r.problem) for r in ev.validate_scores(frame(spark, [tuple(bad)])).collect()]
    assert got == [("1", "invalid_probabilities")]


def test_validate_scores(spark):
    ok = row(1, "match", "match", 0.9)
    assert ev.validate_scores(frame(spark, [ok])).isEmpty()
    assert [r.problem for r in ev.validate_scores(frame(spark, [])).collect()] == ["empty"]
    assert [r.problem for r in ev.validate_scores(frame(spark, [ok, ok])).collect()] == ["duplicate_id"]
    swapped = ok[:7] + ("no_match",) + ok[8:]
    assert [r.problem for r in ev.validate_scores(frame(spark, [swapped])).collect()] == ["prediction_does_not_match_scores"]


CONFUSION = [[263, 21, 4], [11, 270, 29], [2, 16, 120]]
LABELS = ["match", "no_match", "insufficient"]


def test_published_confusion_gives_published_accuracy(spark):
    rows, n = [], 0
    for g, line in zip(LABELS, CONFUSION):
        for p, count in zip(LABELS, line):
            for _ in range(count):
                rows.append(row(n, g, p, 0.9, language="ko" if n % 2 else "en"))
                n += 1
    df = frame(spark, rows)
    s = agg.summarize(df).first()
    assert (s.n, s.correct, s.match_to_no_match) == (736, 653, 21)
    assert s.sensitive_miss_rate == 21 / 288
    cells = {(r.gold, r.prediction): r.n for r in agg.confusion(df).collect()}
    assert [[cells[g, p] for p in LABELS] for g in LABELS] == CONFUSION
    a = agg.action_counts(df, {"allow": 0.5, "block": 0.5}).first()
    assert a.block + a.allow + a.review == a.rows == 736


def test_folds_cover_each_row_once(spark):
    df = frame(spark, [row(i, "match", "match", 0.9, family=f"f{i % 12}") for i in range(24)])
    folds = ev.family_folds(df)
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert sorted(sizes) == [2] * 6
    out = ev.cross_validate(df)
    assert ev.cross_validate_total(out).first().rows == 24


def python_fine(rows):
    out = {}
    for action, label, col in (("allow", "no_match", 9), ("block", "match", 8)):
        wrong = [r[col] for r in rows if r[7] == label and r[5] != label]
        t = max(0.5, (math.floor(max(wrong, default=0) * 10000) + 1) / 10000)
        if len({r[1] for r in rows if r[7] == label and r[col] >= t}) < 3:
            t = 1.0001
        out[action] = t
    return out


def test_cross_validation_matches_a_fold_loop(spark):
    rng = random.Random(2)
    rows = [
        row(i, rng.choice(LABELS), rng.choice(LABELS), round(rng.uniform(0.4, 1), 4), family=f"f{rng.randint(0, 30)}")
        for i in range(400)
    ]
    df = frame(spark, rows)
    fold = {r.source_family: r.fold for r in ev.family_folds(df).collect()}
    got = {r.fold: r for r in ev.cross_validate(df).collect()}
    for k in range(6):
        expect = python_fine([r for r in rows if fold[r[1]] != k])
        held = [r for r in rows if fold[r[1]] == k]
        assert (got[k].gate_allow, got[k].gate_block) == (expect["allow"], expect["block"])
        assert got[k].rows == len(held)
        assert got[k].block == sum(r[7] == "match" and r[8] >= expect["block"] for r in held)


def test_order_statistics_on_skewed_values(spark):
    rng = random.Random(8)
    values = [rng.choice([0.0, 5.0, 5.0, -3.5, 1e9, 1e-9, rng.uniform(1, 2)]) for _ in range(2001)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0), ("b", None)], "k string, v double")
    n = F.col("n")
    got = {
        r.k: r
        for r in order_statistics(
            df, ["k"], "v", {"lo": F.lit(0), "mid": F.floor((n - 1) / 2), "p95": F.floor((n - 1) * 0.95), "top": n - 1}
        ).collect()
    }
    s = sorted(values)
    assert (got["a"].lo, got["a"].mid, got["a"].p95, got["a"].top) == (s[0], s[1000], s[1900], s[-1])
    assert (got["b"].n, got["b"].mid) == (1, 7.0)


def test_latency_rules(spark):
    df = spark.createDataFrame([("g", float(i), 200 if i < 19 else 500) for i in range(1, 21)], "group string, ms double, status int")
    r = ev.probe_groups(df).first()
    assert (r.n, r.success, r.p50, r.p95, r.p95_ok, r.errors) == (20, 18, 10.5, 19.0, 17.0, 2)
    lin = agg.latency_linear(df, ["group"], "ms").first()
    assert lin.p50 == 10.5 and abs(lin.p95 - 19.05) < 1e-9


def test_slices_and_tags(spark):
    df = frame(spark, [row(1, "match", "match", 0.9, tags=["t", "t", "u"]), row(2, "match", "no_match", 0.9, language="en", tags=["u"])])
    got = {(r.slice, r.value): r.n for r in agg.slices(df).collect()}
    assert got == {("language", "ko"): 1, ("language", "en"): 1, ("policy_language", "ko"): 2, ("policy_id", "p"): 2, ("all", None): 2}
    assert {r.tag: r.n for r in agg.tag_slices(df).collect()} == {"t": 1, "u": 2}


def test_cascade_and_review_subset(spark):
    first = frame(spark, [row(1, "match", "match", 0.95), row(2, "no_match", "no_match", 0.6)])
    second = frame(spark, [row(1, "match", "no_match", 0.99), row(2, "no_match", "no_match", 0.99)])
    g = {"allow": 0.9, "block": 0.9}
    out = ev.cascade(first, g, second, g).first()
    assert (out.block, out.allow, out.review) == (1, 1, 0)
    assert ev.review_subset(first, g, second).first().n == 1


def test_margin_diagnostic_without_rows(spark):
    got = {r.label: (r.highest_wrong, r.median_right, r.right_above) for r in agg.margin_diagnostic(frame(spark, [row(1, "match", "match", 0.75)])).collect()}
    assert got == {"match": (0.0, 0.75, 1), "no_match": (0.0, 0.0, 0)}
