import math

import numpy as np
import pytest

from quietgate.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k):
    usable = [
        (i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, x in {i: (i, x) for i, x in usable if i % every == 0}.values():
        scored = [(-sum(a * b for a, b in zip(x, y)), i) for i, y in usable if i != q and len(y) == len(x)]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def run(spark, rows, every, k, monkeypatch=None, **sizes):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in topk.search(df, every, k).collect())


def test_ties_copies_and_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=5)], 1) for i in range(150)]
    rows += [(200 + i, [0.5, 0.25, 0.0, -1.0, 1.0], None) for i in range(120)]  # a third are one vector
    rows += [(500, None, 1), (501, [1.0, None, 0.0, 0.0, 0.0], 1), (502, [float("nan")] * 5, 1),
             (503, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1), (None, [1.0] * 5, 1), (520, [], 1), (540, [1.0, 2.0], 1),
             (541, [3.0, 4.0], 1)]
    assert run(spark, rows, 20, 10) == brute(rows, 20, 10)
    with pytest.raises(Exception, match="no long"):
        run(spark, rows + [(600, [1e20] * 3, 1)], 20, 10)


def test_scores_near_the_ends_of_a_long(spark):
    big = 2.0**21  # scaled 2^31: products of two are 2^62
    rows = [(0, [big, 0.0], 0), (1, [big * 1.5, 1.0], 0), (2, [-big * 1.5, 2.0], 0), (3, [big * 1.5, 3.0], 0), (4, [1.0, 1.0], 0)]
    assert run(spark, rows, 4, 10) == brute(rows, 4, 10)
    with pytest.raises(Exception, match="no long"):
        run(spark, [(0, [2.0**24], 0), (1, [2.0**24], 0)], 100, 10)


def test_large_components_are_exact(spark):
    rows = [(i, [float(2.0 ** (18 + i % 3)), -3.0 * i, 1.0], 0) for i in range(40)]
    assert run(spark, rows, 10, 3) == brute(rows, 10, 3)


def test_fewer_candidates_than_k_and_none(spark):
    rows = [(0, [1.0, 2.0], 0), (1, [2.0, 1.0], 0), (2, [0.0, 0.0], 0)]
    assert run(spark, rows, 100, 10) == brute(rows, 100, 10)
    assert run(spark, rows[:1], 100, 10) == []
    assert run(spark, [], 100, 10) == []


def test_extra_columns(spark):
    df = spark.createDataFrame([(0, [1.0], 0, "a", 1), (1, [2.0], 0, "b", 2)], SCHEMA + ", part string, dim int")
    assert [tuple(r) for r in topk.search(df).collect()] == [(0, 1, 1, 1024 * 2048)]
