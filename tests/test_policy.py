import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from quietgate.functions.rules import RULE_IDS
from quietgate.operators import decide as dec
from quietgate.operators import filters, joins, windows

BLOCK_ALL = {r: "block" for r in RULE_IDS}
POLICY = "revision long, rules map<string,string>, issued_at long, expires_at long"
EVENT = "event_id string, ts_s long, reason string, rules array<string>"


def act(spark, events, policies):
    out = dec.effective_action(
        spark.createDataFrame(events, EVENT), spark.createDataFrame(policies, POLICY)
    )
    return {
        r.event_id: (r.effective_reason, r.effective_action, r.effective_revision)
        for r in out.collect()
    }


def test_effective_action(spark):
    monitor = BLOCK_ALL | {"email": "monitor"}
    policies = [(4, monitor, 100, 200), (5, {}, 1000, 2000)]
    events = [
        ("clean", 150, "clean", []),
        ("mail", 150, "sensitive_data", ["email"]),
        ("both", 150, "sensitive_data", ["email", "credit_card"]),
        ("odd", 150, "whatever", ["email"]),
        ("early", 39, "clean", []),
        ("skew", 40, "clean", []),
        ("expired", 200, "sensitive_data", ["email"]),
        ("absent", 1500, "sensitive_data", ["email"]),
    ]
    assert act(spark, events, policies) == {
        "clean": ("clean", "allow", 4),
        "mail": ("sensitive_data", "monitor", 4),
        "both": ("sensitive_data", "block", 4),
        "odd": ("uninspectable_request", "block", 4),
        "early": ("policy_unavailable", "block", 0),
        "skew": ("clean", "allow", 4),
        "expired": ("policy_unavailable", "block", 0),
        "absent": ("sensitive_data", "block", 5),
    }


def test_policy_asof_for_arbitrary_intervals(spark):
    rng = random.Random(5)
    policies = []
    for revision in range(1, 60):
        start = rng.randint(0, 500_000)
        policies.append((revision, {}, start, start + rng.choice([1, 59, 3600, 86_400, 604_800])))
    edges = [p[2] - 60 for p in policies] + [p[3] for p in policies]
    times = [max(0, e + d) for e in edges for d in (-1, 0, 1)] + [rng.randint(0, 1_200_000) for _ in range(300)]
    events = spark.createDataFrame(list(enumerate(times)), "id int, ts_s long")
    held = joins.policy_asof(events, spark.createDataFrame(policies, POLICY), bucket=7200)
    for row in held.collect():
        valid = [r for r, _m, lo, hi in policies if lo <= row.ts_s + 60 and hi > row.ts_s]
        assert row.in_force == max(valid, default=0), row


def test_revision_check(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t + dt.timedelta(hours=i), i, r, h) for i, (r, h) in enumerate(
        [(2, "a"), (2, "a"), (2, "b"), (1, "z"), (3, "c"), (2, "a"), (3, "c")]
    )]
    df = spark.createDataFrame(rows, "device_id int, ts timestamp, seq int, revision long, content_hash string")
    got = [r.outcome for r in windows.revision_check(df, chunk=7200).orderBy("seq").collect()]
    assert got == [
        "accepted", "accepted", "policy_revision_conflict", "policy_revision_regressed",
        "accepted", "policy_revision_regressed", "accepted",
    ]


def fold_publish(rows, start):
    current, won = start, set()
    for ts, pid, expected in sorted(rows):
        if expected == current:
            won.add(pid)
            current += 1
    return won


def test_publish_outcome_matches_the_sequential_rule(spark):
    rng = random.Random(11)
    for case in range(4):
        n = 60
        rows = [
            (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randint(0, 90)), i,
             max(1, int(i / 4) + rng.choice([-3, -1, 0, 0, 1, 4])))
            for i in range(n)
        ]
        if case == 3:
            rows = [r for r in rows if r[2] != 6]
        df = spark.createDataFrame(rows, "ts timestamp, id int, expected_revision long")
        out = windows.publish_outcome(df, start=1, chunk=5).collect()
        assert {r.id for r in out if r.outcome == "published"} == fold_publish(rows, 1)
        assert len(out) == n or case == 3


def test_a_chain_of_a_thousand_revisions_takes_few_rounds(spark, monkeypatch):
    cuts = []
    kept = windows.cut
    monkeypatch.setattr(windows, "cut", lambda df: cuts.append(1) or kept(df))
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(seconds=3 * r), 2 * r, r) for r in range(1, 1001)]
    rows += [(base + dt.timedelta(seconds=3 * r + 1), 2 * r + 1, r) for r in range(1, 1001)]
    df = spark.createDataFrame(rows, "ts timestamp, id int, expected_revision long")
    out = windows.publish_outcome(df, start=1).collect()
    assert {r.id for r in out if r.outcome == "published"} == {2 * r for r in range(1, 1001)}
    assert len(cuts) <= 2 + 2 * 12


def test_two_proposals_one_wins(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, 1, 1), (t, 2, 1)], "ts timestamp, id int, expected_revision long")
    got = {r.id: (r.outcome, r.revision) for r in windows.publish_outcome(df).collect()}
    assert got == {1: ("published", 2), 2: ("conflict", None)}


def test_timeline_and_latest(spark):
    df = spark.createDataFrame([(1, 0, 100), (2, 50, 150), (3, 300, 400)], "revision long, issued_at long, expires_at long")
    got = [(r.valid_from, r.valid_to) for r in windows.policy_timeline(df, span=2).orderBy("revision").collect()]
    assert got == [(0, 50), (50, 150), (300, 400)]
    assert filters.latest_policy(df).first().revision == 3


SCENARIOS = {
    "customer_upload": "personal_ai", "m365_grounding": "internal_ai", "drive_personal": "personal_ai",
    "cloud_summary": "approved_ai", "rag_acl": "internal_ai", "agent_mail": "external_mail",
}
SCORE = "request_id string, policy_id string, choice string, match double, no_match double, insufficient double"
CONTENT_POLICY = (
    "pos int, id string, enabled boolean, scenarios array<string>, destinations array<string>, "
    "effect string, threshold double, uncertainty_action string"
)


def facts(spark):
    rows = []
    for s, d in SCENARIOS.items():
        for v in ("protected", "allowed"):
            label = "unlabelled"
            if s == "m365_grounding":
                label = "ai_processing_prohibited" if v == "protected" else "public"
            rows.append((s, v, d, label, not (s == "rag_acl" and v == "protected"), True))
    return spark.createDataFrame(
        rows, "scenario_id string, variant string, destination string, document_label string, acl_allowed boolean, tool_allowed boolean"
    )


def run(spark, requests, policies, scores, current=3):
    rows = [
        (f"q{i}", s, v, t, None, None, a) for i, (s, v, t, a) in enumerate(requests)
    ]
    df = spark.createDataFrame(
        rows,
        "request_id string, scenario_id string, variant string, text string, extraction_error string, filename_hash string, approval_id string",
    )
    return df, dec.decide(
        df, facts(spark), spark.createDataFrame(policies, CONTENT_POLICY),
        spark.createDataFrame(scores, SCORE), 3, current,
    )


SHARED = (["customer_upload", "drive_personal", "agent_mail"], ["personal_ai", "external_mail"])


def test_gates_in_order(spark):
    secret = "sk-" + "ant-" + "a" * 24
    requests = [
        ("rag_acl", "protected", secret, None),
        ("m365_grounding", "protected", "text", None),
        ("drive_personal", "allowed", " 　\n", None),
        ("cloud_summary", "allowed", f"{secret} a@b.com", None),
        ("cloud_summary", "allowed", "mail a@b.com", None),
        ("agent_mail", "allowed", "mail a@b.com", None),
        ("rag_acl", "allowed", "mail a@b.com", None),
        ("rag_acl", "allowed", "plain", None),
    ]
    _df, out = run(spark, requests, [], [])
    got = [(r.action, r.reason) for r in out.orderBy("request_id").collect()]
    assert got == [
        ("block", "source_acl_denied_before_retrieval"),
        ("block", "label_prohibits_ai_processing"),
        ("review", "empty_content"),
        ("block", "secret_detected"),
        ("redact", "supported_identifiers_redacted"),
        ("block", "direct_identifier_detected"),
        ("allow", "policy_allowed"),
        ("allow", "policy_allowed"),
    ]
    assert "text" not in out.columns


def fold_policies(steps):
    action, reason = "allow", "policy_allowed"
    for step in steps:
        if step is None:
            continue
        candidate, why = step
        if candidate == "block" or action != "block":
            action, reason = candidate, why
        if action == "block":
            break
    return action, reason


def test_semantic_fold_matches_the_sequential_rule(spark):
    options = {
        "pass": ("no_match", 0.05, 0.9, 0.05),
        "hit": ("match", 0.9, 0.05, 0.05),
        "doubt": ("insufficient", 0.1, 0.2, 0.7),
        "weak": ("match", 0.45, 0.3, 0.25),
        "bad": ("match", 0.9, 0.9, 0.1),
        "lost": None,
    }
    effects = ["review", "block", "review"]
    policies = [
        (i, f"p{i}", True, *SHARED, effects[i], 0.5, "review") for i in range(3)
    ] + [(3, "off", False, *SHARED, "block", 0.5, "block")]
    combos = list(itertools.product(options, repeat=3))
    scores, expect = [], []
    for n, combo in enumerate(combos):
        steps = []
        for i, kind in enumerate(combo):
            if options[kind]:
                scores.append((f"q{n}", f"p{i}", *options[kind]))
            steps.append(
                {
                    "pass": None, "hit": (effects[i], "semantic_policy_match"),
                    "doubt": ("review", "judge_uncertain"), "weak": ("review", "judge_uncertain"),
                    "bad": ("block", "invalid_judge_scores"), "lost": ("block", "judge_unavailable"),
                }[kind]
            )
        expect.append(fold_policies(steps))
    _df, out = run(spark, [("drive_personal", "allowed", "plain", None)] * len(combos), policies, scores)
    got = {r.request_id: (r.action, r.reason) for r in out.collect()}
    for n, combo in enumerate(combos):
        assert got[f"q{n}"] == expect[n], combo


def test_revision_change_blocks_everything(spark):
    _df, out = run(spark, [("rag_acl", "allowed", "plain", None)], [], [], current=4)
    assert out.first().reason == "policy_changed_during_inspection"


def test_approvals(spark):
    requests = [("drive_personal", "allowed", "", a) for a in ("ok", "ok", "late", "used", "denied", "none", None)]
    requests.append(("rag_acl", "protected", "x", "blocked"))
    requests.append(("rag_acl", "allowed", "x", "pointless"))
    _df, out = run(spark, requests, [], [])
    digest = out.filter("request_id = 'q0'").first().request_digest
    now = dt.datetime(2024, 1, 1)
    later = now + dt.timedelta(seconds=600)
    rows = [
        ("ok", digest, 3, "approved", later, None),
        ("late", digest, 3, "approved", now - dt.timedelta(seconds=1), None),
        ("used", digest, 3, "approved", later, now),
        ("denied", digest, 3, "denied", later, None),
        ("blocked", digest, 3, "approved", later, None),
        ("pointless", digest, 3, "approved", later, None),
    ]
    approvals = spark.createDataFrame(
        rows, "id string, digest string, revision long, status string, expires timestamp, consumed timestamp"
    )
    got = [(r.action, r.reason) for r in dec.apply_approvals(out, approvals, now).orderBy("request_id").collect()]
    refused = ("block", "approval_context_invalid_or_consumed")
    assert got == [
        ("allow", "bound_human_approval"), refused, refused, refused, refused, refused,
        ("review", "empty_content"), ("block", "source_acl_denied_before_retrieval"), refused,
    ]


def test_release_set(spark):
    text = "문의 010-1234-5678, a.b@example.test"
    df, out = run(
        spark,
        [("cloud_summary", "allowed", text, None), ("rag_acl", "allowed", "a@b.com", None), ("rag_acl", "protected", "x", None)],
        [], [],
    )
    rows = {r.request_id: r for r in dec.release_set(out, df).collect()}
    assert set(rows) == {"q0", "q1"}
    assert rows["q0"].released_text == "문의 [REDACTED:kr_phone], [REDACTED:email]"
    assert rows["q1"].released_text == "a@b.com"
    assert rows["q0"].byte_count == len(rows["q0"].released_text.encode())


def test_token_redeem(spark):
    t = dt.datetime(2024, 1, 1)
    tokens = spark.createDataFrame([("a", t), ("b", t)], "token string, issued_at timestamp")
    m = lambda k: t + dt.timedelta(minutes=k)
    uses = spark.createDataFrame(
        [("a", 1, m(16)), ("a", 2, m(3)), ("a", 3, m(2)), ("b", 4, m(15)), ("c", 5, m(1))],
        "token string, use_id int, used_at timestamp",
    )
    got = {r.use_id for r in windows.token_redeem(tokens, uses).filter("accepted").collect()}
    assert got == {3}


def test_filters(spark):
    rows = [(1, 10.0, None), (2, 20.0, "high")]
    df = spark.createDataFrame(rows, "id int, ts double, severity string")
    assert [r.id for r in filters.recent(df).collect()] == [2, 1]
    assert [r.id for r in filters.recent(df, only_findings=True).collect()] == [2]
    assert [r.id for r in filters.recent(df, after_id=1).collect()] == [2]
    assert filters.get_event(df, 3).isEmpty()
    lang = df.select(filters.language_of(F.lit("a 한")).alias("x"), filters.language_of(F.lit("a")).alias("y")).first()
    assert (lang.x, lang.y) == ("ko", "en")


def test_approvals_replayed_in_order_of_arrival(spark):
    """Against one pass over everything that arrives, sorted."""
    draw = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    at = lambda: start + dt.timedelta(seconds=draw.randrange(0, 1500, 30))
    asks = [(i % 40, f"d{i % 3}", i % 2, at()) for i in range(55)]
    answers = [(draw.randrange(45), n, draw.choice(["approved", "approved", "denied", "maybe"]), at()) for n in range(140)]
    uses = [(draw.randrange(45), n, f"d{draw.randrange(3)}", draw.randrange(2), at()) for n in range(400)]
    answers.append((None, 900, "approved", start))
    uses.append((1, 901, None, None, start))
    now = start + dt.timedelta(seconds=1200)
    held = {}
    came = [(a[-1], 0, a) for a in asks] + [(a[-1], 1, a) for a in answers] + [(u[-1], 2, u) for u in uses]
    order = lambda c: (c[0], c[1], c[2][1] if c[1] else c[2][1:3])
    for when, kind, row in sorted(came, key=order):
        if when > now:
            continue
        known = held.get(row[0])
        if kind == 0 and known is None:
            held[row[0]] = {"fits": row[1:3], "end": when + dt.timedelta(seconds=600), "state": "pending", "by": None}
        elif known is None or when > known["end"]:
            continue
        elif kind == 1 and known["state"] == "pending" and row[2] in ("approved", "denied"):
            known["state"] = row[2]
        elif kind == 2 and known["state"] == "approved" and row[2:4] == known["fits"]:
            known.update(state="consumed", by=row[1])
    want = {
        (i, "expired" if k["state"] in ("pending", "approved") and k["end"] < now else k["state"], k["by"])
        for i, k in held.items()
    }
    got = dec.replay_approvals(
        spark.createDataFrame(asks, "id int, digest string, revision int, at timestamp_ntz"),
        spark.createDataFrame(answers, "id int, answer_id int, status string, at timestamp_ntz"),
        spark.createDataFrame(uses, "id int, request_id int, digest string, revision int, at timestamp_ntz"),
        now,
    ).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {r.state for r in got} == {"pending", "approved", "denied", "consumed", "expired"}


def test_approval_match_decides_once(spark):
    from quietgate.plans import policy_queries
    from quietgate.plans.derived import frame

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    inputs = [frame(spark, "/root/testdata/sf0.001", n) for n in ("planted", "content", "facts", "content_policies", "content_scores")]
    content = inputs[1].limit(50).localCheckpoint()
    inputs[1] = content.mapInArrow(count, content.schema)
    assert policy_queries.approval_match(*inputs).count() == 50
    # A decision reads the requests' texts and, for the scored policies, their keys.
    assert seen.value <= 100
