import hashlib
import random
from collections import defaultdict

import pyarrow as pa
import pytest

from quietgate.llm import suffixes

from .rows import awkward, frame


def brute(rows):
    at = defaultdict(list)
    raws = [(t or "").encode() for _, t, *_ in rows]
    for i, r in enumerate(raws):
        for p in range(len(r) - suffixes.WINDOW + 1):
            at[r[p : p + suffixes.WINDOW]].append((i, p))
    gone = [bytearray(len(r)) for r in raws]
    for places in at.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + suffixes.WINDOW] = b"\1" * suffixes.WINDOW
    return raws, gone


def expected(rows):
    raws, gone = brute(rows)
    out = []
    for (doc, *_), raw, mask in zip(rows, raws, gone):
        rest = bytes(b for b, g in zip(raw, mask) if not g)
        runs = sum(1 for j in range(len(mask)) if mask[j] and (j == 0 or not mask[j - 1]))
        out.append((doc, len(raw), sum(mask), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def spliced(n=140, seed=5):
    """Texts that share passages, whole or clipped by a few characters on either side."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    passages = [" ".join(word() for _ in range(k)) for k in (60, 80, 90, 120, 200)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randint(0, 60) if rng.random() < 0.5 else 0
                parts.append(p[a : len(p) - rng.choice([0, 0, 1, 2, 3, rng.randint(0, 60)])])
            else:
                parts.append(" ".join(word() for _ in range(rng.randint(0, 80))))
        rows.append((1000 + i, rng.choice([" ", "x", "", "ab"]).join(parts), "en", "a", 0))
    return rows


SHORT = [r if len(r[1] or "") < 20_000 else (*r[:1], r[1][:9000], *r[2:]) for r in awkward()]


@pytest.mark.parametrize("clash", [False, True])
def test_against_every_window(spark, clash):
    rows = SHORT + spliced() + [(2000, "ab " * 400, "en", "a", 0), (2001, "ab " * 133 + "a", "en", "a", 0), (2002, "x" * 401, "en", "a", 0)]
    got = suffixes.summary(frame(spark, rows, clash)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows)


def test_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_PIECE", 700)
    monkeypatch.setattr(suffixes, "_BUFFER", 900)
    rows = spliced(60, 8) + SHORT
    got = suffixes.summary(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows)


def test_strings_whose_sides_have_different_partners(spark):
    """A window whose neighbours by either side do not share it, but a third text does."""
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    core, left, right = text(330), text(80), text(80)
    rows = []
    for i, (a, b) in enumerate([(80, 10), (10, 80), (35, 35), (40, 40), (36, 38), (70, 5), (0, 75), (39, 31)]):
        rows.append((i, text(50) + left[80 - a :] + core + right[:b] + text(50), "en", "a", 0))
    for seed in range(3):
        rng.shuffle(rows)
        got = suffixes.summary(frame(spark, rows)).collect()
        assert sorted((tuple(r) for r in got), key=repr) == expected(rows)


def test_extension_is_verified_on_bytes():
    a = suffixes.Suffix(0, b"", b"abcd", [0, 1, 2, 3, 4], ())
    b = suffixes.Suffix(0, b"", b"abxd", [0, 1, 2, 3, 4], ())  # hashes that collide
    assert suffixes.extension(a, b) == 2
    keys = [b"", b"b", b"ab", b"abc", b"abd", b"a" * 80]
    made = [suffixes.Suffix(1, k, b"", h, (k,)) for k, h in zip(keys, suffixes.prefix_hashes(keys))]
    assert [s.key for s in suffixes.suffix_order(made)] == sorted(keys)
    assert suffixes.by_turns(b"abcd", b"xy") == b"axbycd" and suffixes.by_turns(b"", b"xy") == b"xy"


def test_documents_without_their_repeats(spark):
    docs = frame(spark, SHORT, clash=True)
    got = suffixes.deduplicated(docs)
    assert got.columns == docs.columns
    raws, gone = brute(SHORT)
    want = []
    for (doc, text, lang, source, n), raw, mask in zip(SHORT, raws, gone):
        rest = bytes(b for b, g in zip(raw, mask) if not g).decode("utf-8", "ignore")
        want.append((doc, None if text is None else rest, lang, source, None if text is None else len(rest), "own id"))
    assert sorted((tuple(r)[:6] for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert suffixes.summary(frame(spark, [])).collect() == []


def test_many_suffixes_of_one_key_are_split(spark, monkeypatch):
    """A passage whose anchors all have one right side: its rows go to many tasks, in small chunks."""
    most = []
    order = suffixes.suffix_order
    monkeypatch.setattr(suffixes, "suffix_order", lambda members: most.append(len(members)) or order(members))
    rng = random.Random(7)
    key = rng.randbytes(suffixes.MARGIN)
    tags = [(i, i, 0) for i in range(3 * suffixes._CHUNK)]
    sides = sorted((rng.randbytes(suffixes.MARGIN), key, tag) for tag in tags)
    names = ["side", "gram", "gram2", "id", "hash", "place", "left", "right"]

    class Context:
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(suffixes.TaskContext, "get", staticmethod(lambda: Context))
    batch = pa.RecordBatch.from_pydict(
        {n: c for n, c in zip(names, zip(*[(0, 1, 1, *tag, left, right) for left, right, tag in sides]))}
    )
    found = [r for out in suffixes._sorted_runs(iter([batch])) for r in out.to_pylist()]
    pairs = [r for r in found if r["kind"] == suffixes._PAIR]
    assert [p["id"] for p in pairs] == [t[0] for a, b in zip(sides, sides[1:]) for t in (a[2], b[2])]
    assert max(most) <= suffixes._CHUNK


def test_rows_of_equal_key_are_dealt_to_several_tasks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(suffixes, "stored", lambda df: seen.append(df) or df)
    key = bytes(suffixes.MARGIN)
    rows = [(1, 1, i, i, 0, b"%080d" % i, key, suffixes.by_turns(b"%080d" % i, key)) for i in range(4000)]
    names = "gram long, gram2 long, id long, hash long, place long, left binary, right binary, mixed binary"
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merge)
    spark.conf.set(merge, "false")  # so few rows would be one task
    try:
        got = suffixes._adjacent(spark.createDataFrame(rows, names))
        assert seen[0].filter(f"kind = {suffixes._EDGE} and side = 0").select("part").distinct().count() > 1
        assert got.filter("size(open) + size(known) > 0").count() == 4000
    finally:
        spark.conf.set(merge, before)
