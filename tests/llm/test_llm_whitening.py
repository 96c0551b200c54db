import math

import numpy as np
import pytest
from llm_cases import SF, given
from pyspark.sql import functions as F

from postflow.llm import whitening as W
from postflow.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, components=4):
    """Every result but the sign, by a covariance matrix and eigh."""
    kept = [(k, [math.floor(256 * float(c)) for c in v]) for k, v in rows]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[c - s / n for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for key, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for k in range(min(components, len(sums))):
            z = sum((c - s / n) * u for c, s, u in zip(x, sums, vectors[:, k])) / math.sqrt(values[k])
            out.append((key, k + 1, n, deviation, abs(z), values[k] / values.sum()))
    return sorted(out, key=repr)


def agree(found, rows):
    found = sorted(((*r[:4], abs(r[4]), *r[5:]) for r in map(tuple, found)), key=repr)
    expected = slow(rows)
    assert [r[:4] for r in found] == [r[:4] for r in expected]
    assert np.allclose([r[4:6] for r in found], [r[4:6] for r in expected], rtol=1e-9, atol=1e-9)
    assert len({r[6] for r in found}) <= 1 and all(r[6] < 1e-10 for r in found)


def test_query_against_eigh(spark):
    table = given("embeddings")
    found = QUERIES["op11_whitening"](spark, SF)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    agree(found.collect(), list(zip(table.vec_id.tolist(), table.embedding)))


def test_rows_that_do_not_count_ties_and_repeats(spark):
    rnd = np.random.default_rng(5)
    good = [(k, [float(c) for c in rnd.normal(0, k % 3 + 1, 6)]) for k in range(40)]
    good += [(40, good[0][1]), (40, good[0][1]), (7, [-0.0] * 6), (None, good[3][1])]
    bad = [(50, None), (51, [1.0] * 5 + [None]), (52, [math.nan] * 6), (53, [math.inf] + [0.0] * 5), (54, []), (55, [1.0]), (56, [1e30] * 6)]
    rows = [(k, v, 1) for k, v in good + bad]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("x", "c", "d", "n", "at", "component")})
    exact = [(k, np.array(v, np.float32).tolist()) for k, v in good]
    agree(W.whiten(docs).collect(), exact)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 1.0])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])]])
def test_tables_without_variance(spark, rows):
    assert W.whiten(spark.createDataFrame([(k, v, 0) for k, v in rows], SCHEMA)).collect() == []


def test_components_without_variance_are_not_given(spark):
    rows = [(k, [float(k % 7), 2.0 * (k % 7), 3.0, float(k * k % 5), 0.0]) for k in range(60)]
    found = W.whiten(spark.createDataFrame([(k, v, 0) for k, v in rows], SCHEMA)).collect()
    assert {r["component"] for r in found} == {1, 2} and len(found) == 120
    assert abs(sum({r["component"]: r["explained"] for r in found}.values()) - 1) < 1e-12


def test_deviations_beyond_a_long(spark):
    x = np.array([[1 << 52, -(1 << 52)], [3, 4]])
    assert W._deviations(x, 5, [7, 9]) == [None, 5 * 5 * 25 - 2 * 5 * (21 + 36) + 49 + 81]
    assert W._deviations(x[1:], 5, [7, 9]) == [(15 - 7) ** 2 + (20 - 9) ** 2]


@pytest.mark.parametrize("spectrum", [
    np.linspace(1, 50, 50), np.r_[np.full(46, 1.0), 1 + 1e-3, 1 + 2e-3, 1 + 3e-3, 1 + 4e-3], np.r_[np.ones(46), 9, 9, 9, 9],
    np.r_[np.zeros(47), 1e-3, 1, 1e6], np.ones(50), np.linspace(0, 1, 300) ** 0.25,
])
def test_jacobi_davidson(spectrum):
    d = len(spectrum)
    turn = np.linalg.qr(np.random.default_rng(2).standard_normal((d, d)))[0]
    matrix = (turn * spectrum) @ turn.T
    values, found = W.jacobi_davidson(lambda v: matrix @ v, d, 4)
    assert np.allclose(values, np.sort(spectrum)[::-1][:4], rtol=1e-12, atol=1e-12 * spectrum.max())
    assert np.abs(found.T @ found - np.eye(4)).max() < 1e-12
    assert np.abs(matrix @ found - found * values).max() < 1e-12 * spectrum.max()
