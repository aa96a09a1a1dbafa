"""Walk-forward windows from prefix moments against a direct pass over each window."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from realcurve.operators import hedge


def daily(n=1800, groups=("a", "b"), shift=1e6):
    rng = np.random.default_rng(8)
    out = []
    for g in groups:
        day = dt.date(2001, 2, 27)
        for i in range(n):
            day += dt.timedelta(3 if day.weekday() == 4 else 1)
            if rng.random() < 0.05:
                continue
            x, nominal = float(rng.normal(0, 900) + shift), float(rng.normal(0, 5e5))
            linked = None if rng.random() < 0.02 else float(40 * (x - shift) + rng.normal(0, 6e5) + nominal)
            out.append((g, day, None if rng.random() < 0.01 else x, linked, nominal, None if linked is None else linked - nominal))
    return out


@pytest.mark.parametrize("per_year", [5, 150])
def test_windows_equal_a_direct_pass(spark, per_year):
    rows = daily()
    df = spark.createDataFrame(rows, "tenor string, date date, x_usd double, linked_usd double, nominal_usd double, be_usd double")
    got = {(r.tenor, r.month, r.window): r for r in hedge.window_regressions(df, ["tenor"], per_year=per_year).collect()}
    p = pd.DataFrame(rows, columns=["tenor", "date", "x", "l", "n", "be"]).dropna(subset=["be"])
    p["date"] = pd.to_datetime(p["date"])
    want = 0
    for tenor, g in p.groupby("tenor"):
        for month, start in g.groupby(g["date"].dt.to_period("M"))["date"].min().items():
            for tag, years in hedge.WINDOWS.items():
                w = g[(g["date"] >= start - pd.DateOffset(years=years)) & (g["date"] < start)]
                if len(w) < years * per_year or not len(w) or w["date"].min() > start - pd.DateOffset(months=12 * years - 2):
                    continue
                want += 1
                r = got[tenor, month.start_time.date(), tag]
                known = w.dropna(subset=["x"])
                x = known["x"] - known["x"].mean()
                fit = lambda c: float((x * (known[c] - known[c].mean())).sum() / (x * x).sum())
                assert r["rows"] == len(w) and r["n"] == len(known) and r["first_day"] == w["date"].min().date()
                assert np.isclose(r["slope"], fit("be"), rtol=1e-9) and np.isclose(r["l_slope"], fit("l"), rtol=1e-9) and np.isclose(r["n_slope"], fit("n"), rtol=1e-6, atol=1e-6)
                assert np.isclose(r["r2"], np.corrcoef(known["x"], known["be"])[0, 1] ** 2, rtol=1e-7)
    assert want == len(got) > 40


def test_a_window_without_spread_has_no_slope(spark):
    rows = [("a", dt.date(2001, 1, 1) + dt.timedelta(i), 7.25, float(i % 11), 0.0, float(i % 11)) for i in range(1200)]
    df = spark.createDataFrame(rows, "tenor string, date date, x_usd double, linked_usd double, nominal_usd double, be_usd double")
    got = hedge.window_regressions(df, ["tenor"]).collect()
    assert got and all(r.slope is None and r.r2 is None and r.tstat is None for r in got)
    assert hedge.window_regressions(df.where("1 = 0"), ["tenor"]).count() == 0


def test_no_day_meets_a_window(spark):
    rows = daily(900, ("a",))
    df = spark.createDataFrame(rows, "tenor string, date date, x_usd double, linked_usd double, nominal_usd double, be_usd double")
    plan = hedge.window_regressions(df, ["tenor"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
