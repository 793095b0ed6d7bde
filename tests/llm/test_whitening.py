import math

import numpy as np
import pytest

from quietgate.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    usable = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    sizes = [len(x) for _, x in usable]
    dim = max(set(sizes), key=lambda s: (sizes.count(s), s))
    usable = [(i, x) for i, x in usable if len(x) == dim]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    out = {}
    for i, x in usable:
        z = (np.array(x, float) - np.array([s / n for s in sums])) @ vectors / np.sqrt(values)
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        out[i] = (n, deviation, z, values / cov.trace())
    return out


def run(spark, rows):
    return whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()


def rows_of(seed, n, dim, spread=None):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dim, dim)) * (spread if spread is not None else np.arange(1, dim + 1))
    return [(i, [float(x) for x in np.float32(rng.normal(size=dim) @ mix)], 0) for i in range(n)]


def check(found, wanted):
    assert sorted({r["vec_id"] for r in found}, key=str) == sorted(wanted, key=str)
    sign = {}
    for r in found:
        n, deviation, z, share = wanted[r["vec_id"]]
        k = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["explained"] / share[k] - 1) < 1e-9
        assert r["identity_error"] < 1e-9
        if abs(z[k]) > 1e-6:
            sign.setdefault(k, math.copysign(1, z[k] * r["whitened"]))
            assert abs(r["whitened"] * sign[k] - z[k]) < 1e-7 * (1 + abs(z[k]))


def test_against_eigh(spark):
    rows = rows_of(1, 300, 12)
    rows += [(1000 + i, rows[0][1], 1) for i in range(150)]  # a third are one vector
    rows += [(2000, None, 1), (2001, [float("nan")] * 12, 1), (2002, [1.0] * 11 + [None], 1),
             (2003, [float("inf")] * 12, 1), (2004, [1.0, 2.0], 1), (2005, [], 1), (2006, [-0.0] * 12, 1)]
    found = run(spark, rows)
    check(found, brute(rows))
    assert len(found) == (300 + 150 + 1) * 4
    assert len({r["identity_error"] for r in found}) == 1


def test_few_dimensions_repeats_and_null_ids(spark):
    rows = [(None, [1.0, 2.0], 0), (1, [3.0, -1.0], 0), (1, [3.0, -1.0], 0), (2, [0.5, 0.25], 0)]
    found = run(spark, rows)
    assert sorted((r["vec_id"] or -1, r["component"]) for r in found) == [(-1, 1), (-1, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    assert {r["n"] for r in found} == {3}


def test_vectors_on_a_line_have_one_component(spark):
    found = run(spark, [(i, [1.0 * i, 2.0 * i, -1.0 * i], 0) for i in range(20)])
    assert {r["component"] for r in found} == {1}
    assert all(abs(r["explained"] - 1) < 1e-12 for r in found)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]])
def test_nothing_to_whiten(spark, rows):
    assert run(spark, rows) == []


def test_large_values(spark):
    rows = [(i, [float(2**30 * (i % 7)), float(2**29 * (i % 5)), 1.0 * (i % 3)], 0) for i in range(60)]
    found = {r["vec_id"]: r["deviation"] for r in run(spark, rows)}
    exact = {i: d if d < 1 << 63 else None for i, (_, d, _, _) in brute(rows).items()}
    assert found == exact and None in exact.values()
    with pytest.raises(Exception, match="no long"):
        run(spark, rows + [(99, [1e20, 0.0, 0.0], 0)])


def test_factor_and_rotations():
    rng = np.random.default_rng(4)
    for n, rank in ((1, 1), (7, 7), (9, 4), (16, 15)):
        x = rng.normal(size=(n, rank))
        a = x @ x.T
        factor = whitening.pivoted_cholesky(a)
        assert factor.shape == (n, rank)
        assert np.allclose(factor @ factor.T, a)
        values, vectors = whitening.jacobi(factor)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank])
        assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12)
        assert np.allclose(vectors * values @ vectors.T, a)
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_extra_columns(spark):
    rows = [(i, [float(i), float(i * i)], 0, "own", 1) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA + ", x string, component int")
    assert whitening.whiten(df).count() == 18
