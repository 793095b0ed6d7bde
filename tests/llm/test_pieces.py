import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from quietgate.llm import pieces

from .rows import awkward, frame


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(public_tokenizers.path(pieces.MODEL))


def one_by_one(ids, at, i):
    return ids[at[i] : at[i + 1]].tolist()


def test_decoding_gives_every_text_back(vocabulary):
    rng = random.Random(3)
    letters = "ab c▁é字😀\x00 \n\tTHe+"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 15))) for _ in range(2000)]
    texts += ["x" * 5000, "é▁" * 3000, "the" * 9000 + " " + "▁" * 9000, " ", "  a ", ""]
    ids, at = pieces.Lattice(vocabulary).sample(texts, [rng.randint(-(2**63), 2**63 - 1) for _ in texts])
    for i, text in enumerate(texts):
        assert vocabulary.decode(one_by_one(ids, at, i)) == text


@pytest.mark.parametrize("word", ["there", "aé", "xx字y"])
def test_draws_follow_the_weights_of_all_paths(vocabulary, word):
    full = "▁" + word

    def paths(end):
        if not end:
            yield (), 1.0
        for start in range(end):
            found = vocabulary.weight.get(full[start:end])
            if found is None and end == start + 1:
                raw = full[start:end].encode()
                found = tuple(vocabulary.byte_ids[list(raw)].tolist()), pieces.BYTE_WEIGHT ** len(raw)
            elif found is not None:
                found = (found[0],), found[1]
            if found:
                for path, weight in paths(start):
                    yield path + found[0], weight * found[1]

    every = dict(paths(len(full)))
    total = sum(every.values())
    ids, at = pieces.Lattice(vocabulary).sample([word] * 20_000, list(range(20_000)))
    seen = Counter(tuple(one_by_one(ids, at, k)) for k in range(20_000))
    assert set(seen) <= set(every)
    assert max(abs(seen[p] / 20_000 - every[p] / total) for p in every) < 0.015


def test_a_key_decides_whatever_else_is_sampled(vocabulary):
    texts = ["some words of a text", "other words", "some words of a text"]
    together = pieces.Lattice(vocabulary).sample(texts, [5, 6, 7])
    alone = pieces.Lattice(vocabulary).sample(texts[1:2], [6])
    assert one_by_one(*together, 1) == one_by_one(*alone, 0)
    many = {tuple(one_by_one(*pieces.Lattice(vocabulary).sample(texts[:1], [k]), 0)) for k in range(20)}
    assert len(many) > 2


@pytest.mark.parametrize("clash", [False, True])
def test_rows(spark, clash):
    rows = awkward()
    docs = frame(spark, rows, clash)
    got = pieces.digest(pieces.encode(docs)).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    want = Counter((d, len(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.n_chars, r.decoded_sha256) for r in got) == want
    again = pieces.digest(pieces.encode(docs.repartition(5))).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    other = pieces.digest(pieces.encode(docs, seed=1)).collect()
    assert sorted(map(repr, got)) != sorted(map(repr, other))


def test_empty_table(spark):
    assert pieces.digest(pieces.encode(frame(spark, []))).collect() == []


def test_one_stage_and_two_agree(spark):
    docs = frame(spark, awkward(), clash=True)
    two = pieces.digest(pieces.encode(docs)).collect()
    assert sorted(two, key=str) == sorted(pieces.encoded_digest(docs).collect(), key=str)


def test_columns_grow_by_adding():
    column = pieces.Column(np.int64)
    parts = [np.arange(k, k + 3000) for k in range(0, 30000, 3000)]
    for part in parts:
        column.add([part])
    assert (column.all == np.arange(30000)).all()
