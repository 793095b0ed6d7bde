import pytest
from pyspark.sql import functions as F

from quietgate.functions import text as T
from quietgate.operators import requests as req

J, P, X = "application/json", "text/plain", "application/x-www-form-urlencoded"
SENSITIVE, CLEAN, CLOSED = "sensitive_data", "clean", "uninspectable_request"

MAIL, SAFE = "someone@mail.example", "nothing to see"


def quoted(text):
    """The text with every character spelled as a JSON escape."""
    return "".join(f"\\u{ord(c):04x}" for c in text)


def percent(text):
    """The text with every byte spelled as a percent escape."""
    return "".join(f"%{b:02X}" for b in text.encode())


def nested(depth, inner, left="[", right="]"):
    return left * depth + inner + right * depth


# Where a finding may stand in a body: as it is, escaped, in keys, nested, repeated.
FOUND = [
    (P, f"{SAFE} {MAIL}"),
    (P, "call 010-" + "".join(chr(0xFF10 + int(d)) for d in "98765432")),
    (P, "7 900101" + "1234567"),
    (J, f'"{MAIL}"'),
    (J, f'"{quoted(MAIL)}"'),
    (J, f'{{"{quoted(MAIL)}": 1}}'),
    (J, f'{{"a": [{{"b": "{SAFE}"}}, {{"c": "{MAIL.replace("@", quoted("@"))}"}}]}}'),
    (J, nested(31, f'"{MAIL}"')),
    (J, '[5500005555555559]'),
    (X, f"a={percent(MAIL)}"),
    (X, f"{percent(MAIL)}=a"),
    (X, f"a={SAFE.replace(' ', '+')}&a={percent(MAIL)}&b="),
    (X, f"a={percent('{"m": "' + quoted(MAIL) + '"}')}"),
    (X, f"a={percent(chr(34) + '{' + chr(92) + '"m' + chr(92) + '":' + chr(92) + '"' + MAIL + chr(92) + '"}' + chr(34))}"),
    (X, "k=" + percent("-----BEGIN " + "PRIVATE KEY-----") + "zzz"),
]
# Well-formed bodies without a finding, up to every limit.
FINE = [
    (J, x) for x in [
        '""', "0", "-0.5e+2", "true", "false", "null", "[]", "{}", ' { "a" : [ ] , "b" : { } }\r\n\t',
        f'["{quoted("é😀")[:6]}", "\\ud83d\\ude00", "\\b\\f\\/"]', '{"x": {"x": {"x": 0}}}', '[{"x": 1}, {"x": 1}]',
        nested(32, "1"), nested(33, ""), '"\\\\"', "",
    ]
] + [
    (X, x) for x in ["a=", "a=&a=", "a=b%26c%3Dd", "a=%7B%7D", "&".join(f"k{i}=v" for i in range(1024))]
] + [
    (P, "z" * (1 << 20)), ("Text/Plain", SAFE), ("text/plain ; charset=UTF-8", SAFE), ('text/plain; charset="utf\\-8"', SAFE),
    ('text/plain; note="a;charset=utf-16"', SAFE), ("text/plain; charset=us-ascii", SAFE),
]
# Bodies that nobody can read safely: each breaks one rule of its format.
TWICE = [
    '{"k": 1, "k": 1}', f'{{"k": 1, "{quoted("k")}": 2}}', '{"o": {"k": 1, "k": 2}}', '[{"k": 0, "j": 1, "k": 2}]',
]
BROKEN = [
    (J, x) for x in TWICE + [
        nested(33, "1"), "[1", "1]", '{"a": 1', '{"a": }', '{"a" 1}', "{a: 1}", "[1, 2, ]", "[, 1]", "[1 2]", '"a', "\"a\nb\"",
        '"\\q"', '"\\u12"', '"\\ude00"', '"\\ud800x"', "nan", "NaN", "-Infinity", "+1", "00", "1.", ".1", "0x1", "1e", "1e400",
        "tru", "nulll", "'a'", "[] []", "{}{}", "1 x", "   ",
    ]
] + [
    (X, x) for x in [
        "a", "&", "a=1&", "a=%", "a=%4", "a=%zz", "a=%C3", "a=" + percent('{"a": 1, "a": 2}'), "a=" + percent("[1"), "a=NaN",
        "&".join(f"k{i}=v" for i in range(1025)),
    ]
] + [
    (k, SAFE) for k in [
        "", "text", "text/", "text/plain;", "text/plain; charset", "text/plain; charset=utf-16", "text/plain text/plain",
        "text/plain; charset=utf-8; charset=utf-8", 'text/plain; charset="utf-8', "image/png", "text/plain\n", "text/plain, text/plain",
    ]
] + [
    (P, "z" * ((1 << 20) + 1)), ("text/plain; charset=us-ascii", "é"), (X + "; charset=us-ascii", "a=" + percent("é")),
]
CASES = [(SENSITIVE, *c) for c in FOUND] + [(CLEAN, *c) for c in FINE] + [(CLOSED, *c) for c in BROKEN]


def frame(spark, rows):
    return spark.createDataFrame(
        [(f"r{i}", *r) for i, r in enumerate(rows)],
        "id string, host string, method string, path string, content_type string, body binary",
    )


def test_request_cases(spark):
    rows = [("h.test", "POST", "/", kind, bytearray(body.encode())) for _e, kind, body in CASES]
    got = {r.id: r.reason for r in req.inspect_requests(frame(spark, rows)).select("id", "reason").collect()}
    for i, (expect, kind, body) in enumerate(CASES):
        assert got[f"r{i}"] == expect, (kind, body[:80])


@pytest.mark.parametrize(
    "host, method, path, body, expect",
    [
        ("h.test", "GET", "/?q=person%40example.test", b"", SENSITIVE),
        ("h.test", "GET", "/?q=%FF", b"", CLOSED),
        ("h.test", "GET", "/?q=%xy", b"", CLOSED),
        ("h.test", "GET", "/" + "a" * 16383, b"", CLEAN),
        ("h.test", "GET", "/" + "a" * 16384, b"", CLOSED),
        ("h.test", "GET", "/" + "é" * 8192, b"", CLOSED),
        ("h.test", "CONNECT", "/", b"", CLOSED),
        ("h test", "GET", "/", b"", CLOSED),
        ("h.test", "POST", "/", b"\xff", CLOSED),
        ("h.test", "GET", "/a+b%2B", b"", CLEAN),
    ],
)
def test_paths_and_contract(spark, host, method, path, body, expect):
    df = frame(spark, [(host, method, path, P, bytearray(body))])
    assert req.inspect_requests(df).first().reason == expect


def test_joined_strings_are_scanned_alone(spark):
    import random

    from quietgate.functions import spans as S
    from tests import bruteforce
    from tests.test_scan import PIECES

    rng = random.Random(12)
    rows = [
        [["".join(rng.choices(PIECES + ["\x01"], k=rng.randint(0, 5))) for _ in range(rng.randint(1, 4))]]
        for _ in range(800)
    ]
    df = spark.createDataFrame(rows, "s array<string>").withColumn("t", S.join_strings("s"))
    for r in df.select("s", S.rules_of(S.kept_spans("t", joined=True)).alias("rules")).collect():
        assert r.rules == sorted({f[0] for s in r.s for f in bruteforce.detect(s)}), r.s


def test_percent_decode(spark):
    values = ["a%41", "%EF%BF%BD", "�", "%C3%EF%BF%BD", "%F0%9F%98%80", "a+b", "%+1"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r.d for r in df.select(T.percent_decode(F.col("v")).alias("d")).collect()]
    assert got == ["aA", "�", "�", None, "😀", "a+b", None]
    plus = df.select(T.percent_decode(F.col("v"), plus=True).alias("d")).collect()[5].d
    assert plus == "a b"


def test_json_strings_are_decoded(spark):
    text = r'{"k\n":["aé\\","\"q\"",{"":"\/"}]}'
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.json_strings(F.col("t")).alias("s")).first().s == [
        "k\n", "aé\\", '"q"', "", "/",
    ]


def test_events_hold_metadata_only(spark):
    df = frame(spark, [("ChatGPT.com", "POST", "/", P, bytearray(b"a@b.com"))])
    event = req.action_of(req.inspect_requests(df), {"chatgpt.com": "ChatGPT"})
    assert not {"body", "path", "content_type"} & set(event.columns)
    row = event.first()
    assert (row.action, row.event_action, row.service, row.body_len) == ("block", "blocked", "ChatGPT", 7)


def test_conversation_scan(spark):
    conv = spark.createDataFrame(
        [(1, 0, "hi"), (1, 1, "a@b.com"), (1, 2, "4111111111111111"), (2, 0, "ok")],
        "conv_id long, turn long, text string",
    )
    got = {r.conv_id: r for r in req.conversation_scan(conv).collect()}
    assert (got[1].severity, got[1].first_turn, got[1].turns_hit) == ("critical", 1, 2)
    assert (got[2].severity, got[2].first_turn) == (None, None)


OBS = (
    "run string, index int, host string, http_status int, prompt_box_visible boolean, "
    "challenge boolean, login_required boolean, user_messages int, assistant_messages int"
)


def observe(spark, rows):
    full = [("r", i, *r, 1, 2) for i, r in enumerate(rows)]
    return req.select_observation(spark.createDataFrame(full, OBS)).first()


def test_select_observation(spark):
    chat, login = "chatgpt.com", "auth.openai.com"
    one = observe(spark, [(chat, 403, False, False, False), (chat, 200, True, False, False)])
    assert (one.result, one.selected_index, one.user_messages) == ("prompt_visible", 1, 1)
    two = observe(spark, [(chat, 200, True, False, False)] * 2)
    assert (two.result, two.selected_index, two.prompt_box_visible) == ("ambiguous_tabs", None, True)
    stop = observe(spark, [(chat, None, False, False, False), (login, 200, True, False, False)])
    assert (stop.result, stop.selected_index) == ("login_required", 1)
    tie = observe(spark, [(chat, 500, True, False, False), (chat, 404, True, False, False)])
    assert (tie.result, tie.selected_index) == ("http_error", 0)
    none = observe(spark, [("other.test", 200, True, False, False)])
    assert (none.result, none.http_status) == ("page_unavailable", None)


def test_challenge(spark):
    frames = "array(named_struct('url', {u}, 'title', {t}))"
    case = lambda title, body, u="''", t="''": spark.range(1).select(
        req.challenge(F.lit(title), F.lit(body), F.expr(frames.format(u=u, t=t))).alias("c")
    ).first().c
    assert case("Just  a\nMoment...", "")
    assert case("", "", u="'https://Challenges.Cloudflare.com/turnstile'")
    assert case("", "", t="'Verify you are human'")
    assert not case("403", "Forbidden", u="'ftp://challenges.cloudflare.com/'")
    assert not case("403", "Forbidden", u="'::bad'")
