import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quietgate.llm import near

from .rows import awkward, frame, words


def shingles(text):
    """The multiset of five-word shingles, from the definition."""
    tokens, token = [], ""
    for c in text.lower() + " ":
        if (c.isascii() and c.isalnum()) or not c.isascii():
            token += c
        elif token:
            tokens.append(token)
            token = ""
    if 0 < len(tokens) < near.SHINGLE:
        return Counter([tuple(tokens)])
    return Counter(tuple(tokens[i : i + near.SHINGLE]) for i in range(len(tokens) - near.SHINGLE + 1))


def similarity(a, b):
    low, high = sum((a & b).values()), sum((a | b).values())
    return low / high if high else 0.0


def classes(rows):
    bags = [shingles(t or "") for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or similarity(bags[i], bags[j]) >= near.SIMILARITY:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(-(1 << 63) if r[0] is None else r[0])
    return groups


def edits(seed, n, text, k):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        tokens = text.split()
        for _ in range(k):
            tokens[rng.randrange(len(tokens))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(tokens))
    return out


def test_overlap_is_the_weighted_similarity():
    for a, b in [("a b c d e f", "a b c d e f"), ("a b", "a b"), ("", ""), ("x " * 40, "x " * 50), (words(1, 60), words(1, 60)[:-30])]:
        assert near.overlap(near.occurrences(a), near.occurrences(b)) == pytest.approx(similarity(shingles(a), shingles(b)))


@pytest.mark.parametrize("highest", [1, 9, 300])
def test_signatures_are_unbiased(highest):
    rng = np.random.default_rng(highest)
    wa = rng.integers(1, highest + 1, 200)
    wb = np.maximum(1, wa + rng.integers(-highest // 3, highest // 2 + 1, 200))
    estimates = []
    for seed in range(60):
        e = near._mix(np.arange(200, dtype=np.uint64) + np.uint64(seed * 7919 + 1))
        doc = np.repeat([0, 1], 200)
        sign = near.bag_min_hash(doc, np.concatenate((e, e)), np.concatenate((wa, wb)), 2)
        estimates.append((sign[0] == sign[1]).mean())
    exact = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert np.mean(estimates) == pytest.approx(exact, abs=4 * np.sqrt(exact * (1 - exact) / (60 * near.COMPONENTS)) + 1e-9)


@pytest.mark.parametrize("clash", [False, True])
def test_classes_are_the_components_of_all_links(spark, clash):
    base = words(50, 100)
    rows = awkward() + [(100 + i, t, "en", "a", 0) for i, t in enumerate(edits(1, 40, base, 1) + edits(2, 8, base, 4))]
    rows += [(300, "The Same, words! But with (other) signs", "en", "a", 0), (301, "the same words but with other signs", "en", "a", 0),
             (302, "two words", "en", "a", 0), (303, "Two words.", "en", "a", 0)]
    got = near.near_duplicates(frame(spark, rows, clash)).collect()
    assert len(got) == len(rows)
    null = lambda x: None if x == -(1 << 63) else x
    want = Counter((null(i), null(min(g)), len(g)) for g in classes(rows).values() for i in g)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len({(r.class_id, r.class_size) for r in got}) or len(kept) == len(classes(rows))


@pytest.mark.parametrize("rounds", [1, 3])
def test_links_between_others_than_the_centre(spark, monkeypatch, rounds):
    """A chain of texts, each near the next only: one class, however the buckets' centres fall."""
    monkeypatch.setattr(near, "_STAR_ROUNDS", rounds)
    tokens = words(9, 200).split()
    rows = []
    for i in range(12):
        tokens = [*tokens[8:], *words(900 + i, 8).split()]
        rows.append((i, " ".join(tokens), "en", "a", 0))
    got = near.near_duplicates(frame(spark, rows)).collect()
    assert {r.class_id for r in got} == {min(g) for g in classes(rows).values()}


def bucket(spark, rows, inside):
    """All rows in one bucket, those whose number is in ``inside`` in one component, and their multisets."""
    occ = [(i, near.occurrences(t).tobytes()) for i, t in enumerate(rows)]
    open_ = spark.createDataFrame([(i, 1, min(inside) if i in inside else i) for i in range(len(rows))], "row long, band long, comp long")
    return open_, spark.createDataFrame([(i, bytearray(b)) for i, b in occ], "row long, occ binary")


@pytest.mark.parametrize("seed", range(3))
def test_differing_pairs_lose_no_link(spark, seed):
    """Copies near their origin, far from it but near each other, shorter, longer and of other texts."""
    rng = random.Random(seed)
    base = words(seed, 104)
    far = edits(seed + 10, 3, base, 4)
    rows = [base] + edits(seed, 12, base, 1) + [t for f in far for t in [f] + edits(seed + 20, 3, f, 1)] + words(seed + 1, 90).split("\0")
    rows += [" ".join(base.split()[rng.randrange(12):][: 104 - rng.randrange(20)]) for _ in range(12)] + [base.upper(), base + " " + words(7, 11)]
    bags = [shingles(t) for t in rows]
    linked = {(i, j) for j in range(len(rows)) for i in range(j) if similarity(bags[i], bags[j]) >= near.SIMILARITY}
    for inside in ({0, 1}, {5, 9}, set(range(4, len(rows), 2))):
        open_, known = bucket(spark, rows, inside)
        stars, pairs = near._differing_pairs(open_, known)
        stars = {(r.a, r.b) for r in stars.collect()}
        assert stars <= linked
        found = stars | ({(r.a, r.b) for r in pairs.collect()} & linked)
        parent = {i: min(inside) if i in inside else i for i in range(len(rows))}

        def joined(links):
            label = dict(parent)
            for a, b in list(links) * len(rows):
                x, y = sorted((label[a], label[b]))
                if x != y:
                    label = {i: x if c == y else c for i, c in label.items()}
            return label

        assert joined(found) == joined(linked)


def test_a_large_group_does_not_pair_with_all_outside(spark):
    """Copies of one text in one component, and others that are too far from all of them."""
    base = words(50, 104)
    rows = [base] + edits(1, 150, base, 2) + edits(2, 50, base, 3)
    open_, known = bucket(spark, rows, set(range(151)))
    _, pairs = near._differing_pairs(open_, known)
    assert pairs.count() <= len(rows)


def test_one_document_of_each_class_stays(spark):
    rows = awkward() + [(100 + i, t, "en", "a", 0) for i, t in enumerate(edits(1, 10, words(50, 100), 1))]
    docs = frame(spark, rows, clash=True)
    got = near.one_of_each(docs)
    assert got.columns == docs.columns
    groups = classes(rows)
    ids = Counter(r.doc_id if r.doc_id is not None else -(1 << 63) for r in got.collect())
    assert ids == Counter(min(g) for g in groups.values())


def test_empty_table(spark):
    assert near.near_duplicates(frame(spark, [])).collect() == []
    assert near.one_of_each(frame(spark, [])).collect() == []


def test_words_end_at_unicode_separators():
    same = lambda a, b: near.overlap(near.occurrences(a), near.occurrences(b)) == 1
    plain = "one two three four five six seven été naïve"
    for other in (
        "one two “three” four five—six seven ‘été’ naïve", plain.replace(" ", "\u00a0"), plain.replace(" ", "\u3000"), "one two three, four five… six seven «été» naïve。",
        plain.replace("seven", "se\u00adven"),
    ):
        assert same(plain, other), other
    assert not same(plain, plain.replace("été", "ete"))
    assert near.parted("Слово कि한국 é").split() == ["слово", "कि한국", "é"]
    assert near.parted("字字。かな、กิก").split() == ["字", "字", "か", "な", "กิ", "ก"]


def test_scripts_without_blanks_have_a_word_a_letter(spark):
    rng = random.Random(4)
    text = "。".join("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(20)) for _ in range(20))
    rows = [(1, text), (2, text[:200] + "变" + text[201:]), (3, text[::-1])]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 1, 3: 3}
    assert {r.n_shingles for r in got} == {396}
