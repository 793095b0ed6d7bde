import random
import re

import numpy as np
import pytest
import xxhash

from quietgate.llm import simhash

from . import rows as R


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [words[i : i + 4] for i in range(len(words) - 3)] if len(words) >= 4 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(docs):
    prints = [brute_print(t) for _, t, *_ in docs]
    return brute_components([d for d, *_ in docs], prints)


def brute_components(ids, prints):
    label = list(range(len(prints)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                label[top(i)] = top(j)
    low = lambda d: (d is not None, d or 0)
    least = {}
    for i, d in enumerate(ids):
        t = top(i)
        least[t] = min(least.get(t, d), d, key=low)
    return sorted([(d, f"{p:016x}", least[top(i)]) for i, (d, p) in enumerate(zip(ids, prints))], key=str)


def run(spark, docs, clash=False):
    df = simhash.near_duplicates(R.frame(spark, docs, clash))
    return sorted([tuple(r)[:3] for r in df.collect()], key=str)


@pytest.mark.parametrize("clash", [False, True])
def test_awkward_rows(spark, clash):
    assert run(spark, R.awkward(), clash) == brute(R.awkward())


def test_near_copies(spark):
    rng = random.Random(3)
    docs = []
    for i in range(40):
        words = R.words(100 + i, 150).split()
        for j in range(rng.randint(1, 6)):
            copy = words[:]
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "other%d" % rng.randrange(1000)
            docs.append((len(docs), " ".join(copy), "en", "a", 1))
    found = run(spark, docs)
    assert found == brute(docs)
    assert len({c for _, _, c in found}) < len(docs)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, None, None, None, None)]) == [(5, "0" * 16, 5)]


def test_runs_of_a_long_text(monkeypatch):
    text = ("Some words é字 here\t and\nthere " * 300).encode()
    for tail in (b"", b"   ", b"last"):
        monkeypatch.setattr(simhash, "_SLICE", 1 << 20)
        whole = simhash.fingerprints([text + tail, b"", b"two words", text])
        monkeypatch.setattr(simhash, "_SLICE", 64)
        assert (simhash.fingerprints([text + tail, b"", b"two words", text]) == whole).all()
        assert int(whole[0]) == brute_print((text + tail).decode())


def planted(rng, n, centres, flips):
    """Distinct fingerprints around some centres, and random ones."""
    out = {rng.getrandbits(64) for _ in range(n)}
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(flips):
            x = centre
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


def test_a_tree_links_what_pairs_link():
    rng = random.Random(8)
    prints = planted(rng, 500, 4, 120)
    rng.shuffle(prints)
    array = np.array(prints, np.uint64)
    label = simhash.linked(array, np.zeros(len(array), np.int64))
    assert [label[i] == label[j] for i in range(len(prints)) for j in range(0, i, 7)] == [
        a == b for a, b in _pairs(brute_labels(prints))
    ]


def brute_labels(prints):
    named = brute_components(list(range(len(prints))), prints)
    return [c for _, _, c in sorted(named)]


def _pairs(labels):
    return [(labels[i], labels[j]) for i in range(len(labels)) for j in range(0, i, 7)]


@pytest.mark.parametrize("tree", [simhash.TREE, 8])
def test_shards_and_divided_shards(spark, monkeypatch, tree):
    """With tiny trees nearly every shard is divided, and links go from tree to tree."""
    monkeypatch.setattr(simhash, "TREE", tree)
    rng = random.Random(9)
    prints = planted(rng, 300, 3, 150)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.linked_components(spark.createDataFrame([(p,) for p in signed], "print long"))
    label = {r["row"]: r["label"] for r in found.collect()}
    ours = [label.get(p, p) for p in signed]
    wanted = brute_labels(prints)
    assert len(set(zip(ours, wanted))) == len(set(ours)) == len(set(wanted))


def test_searches_enter_no_subtree_of_their_own_component():
    centre = np.uint64(0x123456789ABCDEF)
    one = [centre ^ (np.uint64(1) << np.uint64(i)) for i in range(60)]
    two = [x ^ (np.uint64(1) << np.uint64(j)) for x in one[:20] for j in range(60) if x ^ (np.uint64(1) << np.uint64(j)) != centre]
    prints = np.unique(np.array([centre, *one, *two], np.uint64))
    forest = simhash.Forest(prints, np.zeros(len(prints), np.int64))
    label = simhash.least_labels(len(prints), *forest.links)
    assert (forest.uniform(label)[forest.root] >= 0).all()  # linked by the tree's own edges alone
    assert not len(forest.search(prints, forest.root, label, label)[0])
