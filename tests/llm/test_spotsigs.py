import hashlib
import re

import pytest

from quietgate.llm import spotsigs
from pyspark.sql import functions as F

from .rows import awkward, frame, words


def signs(text):
    """Signatures as tuples of words, from the definition: anchors first, then the words after."""
    tokens = re.findall(r"[^\W_]+", text.lower())
    common = set(spotsigs.COMMON)
    content, anchored, since = [], [True], 0
    for t in tokens:
        if t in common:
            anchored[len(content)] = True
            since = 0
        else:
            if since == spotsigs.STRETCH:
                anchored[len(content)] = True
                since = 0
            if anchored[len(content)]:
                since = 0
            content.append(t)
            anchored.append(False)
            since += 1
    found = {tuple(content[i : i + spotsigs.CHAIN]) for i in range(len(content)) if anchored[i]}
    return found or ({("whole", *tokens)} if tokens else set())


def likeness(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def expected(rows):
    order = sorted({(-(1 << 63) if d is None else d, t or "") for d, t, *_ in rows}, key=lambda x: -x[0])
    ids = [d for d, _ in order]
    assert len(ids) == len(set(ids))  # ties are tested by themselves
    out = {}
    for i, (d, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        out[None if d == -(1 << 63) else d] = (
            len(text), hashlib.sha256(edited.encode()).hexdigest(),
            likeness(signs(text), signs(edited)), likeness(signs(text), signs(following)), len(signs(text)),
        )
    return out


@pytest.mark.parametrize("clash", [False, True])
def test_against_the_definition(spark, clash):
    english = "the cat and a dog were in the house by the sea with some old books on tables for reading "
    rows = [r for r in awkward() if not (r[0] is None and r[1] is None)]
    rows += [(100 + i, english * i + words(i, 20 * i) + " the end of it", "en", "a", 0) for i in range(12)]
    got = spotsigs.edited(frame(spark, rows, clash)).collect()
    assert len(got) == len(rows)
    want = expected(rows)
    for r in got:
        n, sha, near_edited, near_next, size = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.n_signatures) == (n, sha, size), r.doc_id
        assert r.near_edited == pytest.approx(near_edited) and r.near_next == pytest.approx(near_next)
        assert len(r.fingerprint.split()) == size


def test_equal_ids_alone_and_none(spark):
    rows = [(1, "one text", "en", "a", 0), (1, "another text", "en", "a", 0), (1, "one text", "en", "a", 0)]
    got = spotsigs.edited(frame(spark, rows)).collect()
    assert len(got) == 3 and len({r.fingerprint for r in got if r.n_chars == 8}) == 1
    alone = spotsigs.edited(frame(spark, [(5, "a lonely document of words", None, None, None)])).collect()
    assert [r.near_next for r in alone] == [1.0]
    assert spotsigs.edited(frame(spark, [])).collect() == []


def test_near_pairs_are_all_pairs_of_that_likeness(spark):
    base = [words(i, 60) for i in range(6)]
    texts = [(10 * i + j, b.rsplit(" ", 6 * j)[0] + (" " + words(99 + j, j) if j else "")) for i, b in enumerate(base) for j in range(4)]
    prints = spark.createDataFrame(texts, "id long, text string").select("id", spotsigs.signatures(F.col("text")).alias("signs"))
    got = {(r.a, r.b) for r in spotsigs.near_pairs(prints, 0.6).collect()}
    sets = {i: signs(t) for i, t in texts}
    want = {(a, b) for a in sets for b in sets if a < b and likeness(sets[a], sets[b]) >= 0.6}
    assert got == want and want
