"""Whitening against exact rational sums, and double-double arithmetic against fractions."""

import random
from fractions import Fraction

import numpy as np
import pytest

from quillspark.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, label int, x string, i int, component int"


def frame(spark, vectors, schema=SCHEMA):
    rows = [(i if i % 7 else None if i == 14 else i, v, i % 3, "x", 1, 2) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, schema).repartition(4)


def exact(vectors):
    """Whole numbers, exact sums, deviations, and the covariance as fractions rounded once."""
    x = [[int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    c = [[n * r[k] - s[k] for k in range(d)] for r in x]
    v = [[float(Fraction(sum(r[i] * r[j] for r in c), n**3)) for j in range(d)] for i in range(d)]
    return c, [sum(k * k for k in r) for r in c], np.array(v)


def check(spark, vectors, most=w.COMPONENTS, schema=SCHEMA):
    kept = [(i, v) for i, v in enumerate(vectors) if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    c, deviation, v = exact([x for _, x in kept])
    values, vectors_ = np.linalg.eigh(v)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    rows = w.whitened_rows(frame(spark, vectors, schema), most=most).collect()
    n, d = len(c), len(c[0])
    assert len(rows) == n * min(most, d)
    by = {}
    for r in rows:
        by.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    assert sorted((str(k) for k in by)) == sorted({str((i if i % 7 else None if i == 14 else i, t)) for (i, _), t in zip(kept, deviation, strict=True)})
    want = (np.array(c, dtype=object) / n).astype(float) @ vectors_ / np.sqrt(np.maximum(values, 1e-300))
    for k in range(1, min(most, d) + 1):
        got = np.array([by[(i if i % 7 else None if i == 14 else i, t)][k]["whitened"] for (i, _), t in zip(kept, deviation, strict=True)])
        assert np.allclose(got, want[:, k - 1], atol=1e-6) or np.allclose(-got, want[:, k - 1], atol=1e-6)
    assert {r["n"] for r in rows} == {n}
    assert all(abs(r["explained"] - values[r["component"] - 1] / np.trace(v)) < 1e-9 for r in rows)
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9
    return rows


def test_op12_against_exact_sums(spark):
    rnd = np.random.default_rng(1)
    given = (rnd.normal(size=(300, 40)) @ rnd.normal(size=(40, 40))).astype(np.float32).tolist()
    given[5] = None
    given[6][3] = None
    given[8][0], given[9][1], given[10][2] = float("nan"), float("inf"), float("-inf")
    given[12] = []
    check(spark, given)


def test_op12_small_variance_beside_a_large_mean(spark):
    """Means of a billion and a spread of some: a covariance by E[xy] - E[x]E[y] would lose it."""
    rnd = random.Random(2)
    given = [[float(2**30 + rnd.randint(-9, 9)) for _ in range(3)] + [rnd.random()] for _ in range(500)]
    check(spark, given, schema=SCHEMA.replace("array<float>", "array<double>"))


def test_op12_defined_results(spark):
    assert w.whitened_rows(frame(spark, [])).collect() == []
    assert w.whitened_rows(frame(spark, [None, [None], [float("nan")]])).collect() == []
    assert w.whitened_rows(frame(spark, [[], []])).collect() == []
    # one vector, or equal ones: no variance
    for given in ([[1.0, 2.0]], [[1.0, 2.0]] * 3):
        rows = w.whitened_rows(frame(spark, given)).collect()
        assert len(rows) == 2 * len(given) and all(r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in rows)
    # one direction of two, and a vector of another length, and one beyond all whole numbers
    rows = w.whitened_rows(frame(spark, [[1.0, 5.0], [2.0, 5.0], [4.0, 5.0], [1.0], [1e30, 1.0]])).collect()
    assert len(rows) == 6 and sum(r["whitened"] is None for r in rows) == 3 and {r["component"] for r in rows if r["whitened"] is None} == {2}
    assert {r["explained"] for r in rows} == {1.0, 0.0} or all(abs(r["explained"] - (r["component"] == 1)) < 1e-12 for r in rows)
    # numbers that 64 bits don't hold once multiplied: exact all the same, and no deviation
    rows = w.whitened_rows(frame(spark, [[2.0**55, 1.0], [-(2.0**55), 2.0], [2.0**54, 3.0]])).collect()
    assert len(rows) == 6 and all(r["deviation"] is None and (np.isfinite(r["whitened"]) if r["component"] == 1 else r["whitened"] is None) for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_double_double_is_exact_to_a_hundred_bits(seed):
    rnd = np.random.default_rng(seed)
    h, low = rnd.normal(size=(257, 5)) * 10.0 ** rnd.integers(-8, 9, size=(257, 5)), np.zeros((257, 5))
    ph, pl = w.dd_multiply(h, low, h[::-1], low)
    th, tl = w.dd_total(ph, pl)
    for k in range(5):
        want = sum(Fraction(a) * Fraction(b) for a, b in zip(h[:, k].tolist(), h[::-1, k].tolist(), strict=True))
        size = sum(abs(Fraction(a) * Fraction(b)) for a, b in zip(h[:, k].tolist(), h[::-1, k].tolist(), strict=True))
        assert abs(Fraction(float(th[k])) + Fraction(float(tl[k])) - want) <= size / 2**98
    q, r = w.dd_divide(th, tl, 257.0)
    assert all(abs((Fraction(float(a)) + Fraction(float(b))) * 257 - Fraction(float(c)) - Fraction(float(d))) <= abs(Fraction(float(c))) / 2**98 for a, b, c, d in zip(q, r, th, tl, strict=True))


def test_parts_of_tasks_merge_to_the_sum(spark):
    x = np.random.default_rng(4).normal(size=(1000, 7))
    df = spark.createDataFrame([(r,) for r in x.tolist()], "v array<double>")
    centred = lambda batch: (w.matrix(batch.column(0), 7), np.zeros((batch.num_rows, 7)))
    for parts in (1, 13):
        assert np.allclose(w.covariance_of(df.repartition(parts), 7, 1000, centred), x.T @ x / 1000, rtol=1e-13, atol=1e-13)
