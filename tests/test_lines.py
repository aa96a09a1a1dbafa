"""Robust lines against independent solutions."""

import datetime as dt

import numpy as np
import pytest

from realcurve.operators import lines


def groups(seed=1):
    rng = np.random.default_rng(seed)
    out = {}
    for g, n in (("a", 3), ("b", 50), ("c", 401), ("d", 120), ("e", 2)):
        x = rng.normal(0, 10, n)
        y = 2.5 * x - 4 + rng.standard_t(1.5, n)
        out[g] = (x, y)
    out["ties"] = (np.repeat(np.arange(12.0), 5), np.repeat(np.arange(12.0), 5) // 2 + np.tile([0.0, 0, 1, 1, 5], 12))
    out["line"] = (np.arange(9.0), 3 * np.arange(9.0) + 1)
    out["flat"] = (np.full(7, 2.0), np.arange(7.0))
    return out


def frame(spark, data):
    rows = [(g, dt.date(2000, 1, 1) + dt.timedelta(i), float(a), float(b)) for g, (x, y) in data.items() for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "g string, date date, x double, y double")


def all_slopes(x, y):
    i, j = np.triu_indices(len(x), 1)
    ok = x[i] != x[j]
    return np.sort((y[j] - y[i])[ok] / (x[j] - x[i])[ok])


def test_least_absolute_line_is_the_programmes_optimum(spark):
    data = groups()
    got = {r.g: r for r in lines.median_fit(frame(spark, data), ["g"]).collect()}
    for g, (x, y) in data.items():
        if g == "flat":
            assert got[g].slope is None and np.isclose(got[g].loss, np.abs(y - np.median(y)).sum())
            continue
        # a vertex of the programme goes through two points
        i, j = np.triu_indices(len(x), 1)
        ok = x[i] != x[j]
        b = (y[j] - y[i])[ok] / (x[j] - x[i])[ok]
        loss = np.array([np.abs(y - (q - s * p) - s * x).sum() for s, p, q in zip(b, x[i][ok], y[i][ok])])
        assert got[g].loss <= loss.min() * (1 + 1e-12) + 1e-12, g
        assert np.isclose(np.abs(y - got[g].intercept - got[g].slope * x).sum(), got[g].loss)


def huber(x, y):
    w, line = np.ones(len(x)), None
    for _ in range(5000):
        a = np.stack([np.ones(len(x)), x], axis=1) * np.sqrt(w)[:, None]
        new = np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0]
        r = np.abs(y - new[0] - new[1] * x)
        scale = np.median(r) / lines.MAD_SCALE
        if line is not None and np.abs(new - line).max() < 1e-13 or scale < 1e-12:
            return new
        line, w = new, np.where(r <= lines.HUBER_T * scale, 1, lines.HUBER_T * scale / np.maximum(r, 1e-300))
    return line


def test_huber_line_equals_an_independent_solution(spark):
    data = {g: v for g, v in groups(3).items() if g in ("b", "c", "d", "line", "flat")}
    found = lines.huber_line(frame(spark, data), ["g"])
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r.g: r for r in found.collect()}
    for g, (x, y) in data.items():
        if g == "flat":
            assert got[g].slope is None
            continue
        a, b = huber(x, y)
        assert got[g].settled and abs(got[g].slope - b) < 1e-8 and abs(got[g].intercept - a) < 1e-8, g
    assert lines.huber_line(frame(spark, data).where("1 = 0"), ["g"]).count() == 0


def test_median_slope_equals_all_pairs(spark):
    data = groups(4)
    got = {r.g: r for r in lines.theil_sen(frame(spark, data), ["g"]).collect()}
    for g, (x, y) in data.items():
        s = all_slopes(x, y)
        assert got[g].pairs == len(s)
        if len(s):
            assert np.isclose(got[g].slope, np.median(s), rtol=1e-12) and np.isclose(got[g].intercept, np.median(y - got[g].slope * x)), g
        else:
            assert got[g].slope is None


@pytest.mark.parametrize("kind", ["spread", "grid"])
def test_median_slope_of_a_long_group(kind):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1e3, 2000) if kind == "spread" else rng.integers(0, 60, 2000).astype(float)
    y = 1e-3 * x + rng.standard_cauchy(2000) if kind == "spread" else rng.integers(0, 9, 2000).astype(float)
    s = all_slopes(x, y)
    assert np.isclose(lines.median_slope(x, y)[0], np.median(s), rtol=1e-12, atol=1e-300)
    assert np.allclose(lines.slope_of_rank(x, y, [0, 7, len(s) // 3, len(s) - 1]), s[[0, 7, len(s) // 3, len(s) - 1]], rtol=1e-12)


def test_inversions_by_bits():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 64, 65, 200):
        rank = rng.permutation(n)
        assert lines.inversions(rank) == sum(rank[i] > rank[j] for i in range(n) for j in range(i + 1, n))
