"""Hand-made rows for the scalar rules."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from realcurve.functions import daycount as dc
from realcurve.functions import financing as fin
from realcurve.functions import ordered, pricing, stats

D = dt.date


def one(spark, col, **cells):
    df = spark.createDataFrame([tuple(cells.values())], list(cells)) if cells else spark.range(1)
    return df.select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("maturity, months, want", [
    (D(2030, 8, 31), -6, D(2030, 2, 28)), (D(2032, 2, 29), -6, D(2031, 8, 31)), (D(2032, 8, 31), -6, D(2032, 2, 29)), (D(2030, 8, 30), -6, D(2030, 2, 28)),
    (D(2030, 2, 15), -18, D(2028, 8, 15)),
])
def test_shift_keeps_month_end(spark, maturity, months, want):
    assert one(spark, dc.shift_months_eom(F.col("m"), F.lit(months)), m=maturity) == want


def test_pay_dates_are_strictly_after_dated_and_not_chained(spark):
    got = one(spark, dc.pay_dates(F.col("m"), F.col("d"), F.lit(2)), m=D(2001, 8, 31), d=D(2000, 2, 29))
    assert got == [D(2000, 8, 31), D(2001, 2, 28), D(2001, 8, 31)]


@pytest.mark.parametrize("years, want", [(1.49, None), (1.5, "2y"), (3.5, "5y"), (2.5, "2y"), (8.5, "7y"), (11.51, "12y"), (60.0, "30y")])
def test_bucket_edges_round_half_to_even(spark, years, want):
    assert one(spark, dc.bucket_label(F.col("y")), y=years) == want


def test_bucket_long_end_splits(spark):
    assert [one(spark, dc.bucket_label(F.col("y"), F.lit(True)), y=y) for y in (34.4, 34.6, 45.0)] == ["30y", "40y", "50y"]


def test_nth_weekday_absent(spark):
    assert one(spark, dc.nth_weekday(F.col("m"), "TUE", 5), m=D(2024, 2, 1)) is None
    assert one(spark, dc.nth_weekday(F.col("m"), "THU", 5), m=D(2024, 2, 1)) == D(2024, 2, 29)


def metrics_of(spark, **over):
    row = dict(bond_id=1, date=D(2000, 3, 1), settle=D(2000, 3, 2), clean=99.0, ytm=5.0, coupon=6.0, freq=2, dated=D(1999, 11, 20),
               maturity=D(2010, 5, 15), index_ratio=1.0)
    row.update(over)
    return pricing.bond_metrics(spark.createDataFrame([tuple(row.values())], list(row))).first()


def test_first_period_anchors_on_dated_date(spark):
    m = metrics_of(spark)
    assert m["prev_anchor"] == D(1999, 11, 20) and m["next_coupon"] == D(2000, 5, 15)
    assert m["accrued"] == pytest.approx(3.0 * (1 - 74 / 177))


def test_settle_on_coupon_date_accrues_nothing(spark):
    m = metrics_of(spark, settle=D(2001, 5, 15))
    assert m["accrued"] == 0.0 and m["n_left"] == 18


def test_outside_life_is_dropped(spark):
    assert metrics_of(spark, settle=D(1999, 11, 19)) is None
    assert metrics_of(spark, settle=D(2010, 5, 15)) is None


@settings(max_examples=15, deadline=None)
@given(y=st.floats(-1.0, 15.0), w=st.floats(0.01, 1.0), n=st.integers(1, 60), c=st.floats(0.0, 12.0))
def test_closed_form_price_is_the_sum(spark, y, w, n, c):
    yp = y / 200.0
    want = sum(c / 2 * (1 + yp) ** -(k + w) for k in range(n)) + 100 * (1 + yp) ** -(n - 1 + w)
    got = spark.range(1).select(pricing.dirty_price(F.lit(y), F.lit(w), F.lit(n), F.lit(c), F.lit(2)).alias("p"), pricing.dv01(F.lit(y), F.lit(w), F.lit(n), F.lit(c), F.lit(2)).alias("d")).first()
    assert got["p"] == pytest.approx(want, rel=1e-8)
    assert got["d"] > 0


def test_zero_yield(spark):
    assert one(spark, pricing.dirty_price(F.lit(0.0), F.lit(0.5), F.lit(4), F.lit(6.0), F.lit(2))) == pytest.approx(112.0)


def test_ratio_example_and_ties(spark):
    # published worked numbers: reference 307.01552 against base 306.29390
    assert one(spark, pricing.ratio_truncated(F.lit(307.01552), F.lit(306.29390))) == pytest.approx(1.00236)
    assert one(spark, pricing.ratio_truncated(F.lit(1.000015), F.lit(1.0))) == pytest.approx(1.00002)


def test_financing_signs_and_drag(spark):
    v = {x: one(spark, fin.package_financing(F.lit(100.0), F.lit(100.0), F.lit(1), F.lit(3.67), F.lit("long_be"), x)) for x in (0.0, 3.0)}
    assert v[0.0] == pytest.approx(0.0, abs=1e-12)
    assert v[3.0] == pytest.approx(-2 * 100 * 0.0003 / 360)
    with pytest.raises(Exception, match="side must be"):
        one(spark, fin.leg_financing(F.lit(100.0), F.lit(1), F.lit(3.0), F.lit("sideways")))


def test_long_plus_short_is_minus_two_slips(spark):
    df = spark.createDataFrame([(1.5, 0.2, 0.1)], ["r_be_bp", "s_linked", "s_nominal"])
    r = fin.half_spread(df, 3.0, 2.0).first()
    assert r["long_be_bp"] + r["short_be_bp"] == pytest.approx(-2 * (3 * 0.2 + 2 * 0.1))


def test_asof_both_directions(spark):
    left = spark.createDataFrame([("a", i) for i in (1, 5, 9)], ["k", "t"])
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 1, "z")], ["k", "t", "v"])
    back = {r["t"]: r["v"] for r in ordered.asof(left, right, ["k"], "t", ["v"]).collect()}
    fwd = {r["t"]: r["v"] for r in ordered.asof(left, right, ["k"], "t", ["v"], "forward").collect()}
    strict = {r["t"]: r["v"] for r in ordered.asof(left, right, ["k"], "t", ["v"], exact=False).collect()}
    assert back == {1: None, 5: "y", 9: "y"} and fwd == {1: "x", 5: "y", 9: None} and strict == {1: None, 5: "x", 9: "y"}


def test_running_sums_and_null_policy(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 2.0)], "k string, t int, v double")
    lin = [r["c"] for r in ordered.cum_linear(df, ["k"], "t", {"c": "v"}).orderBy("t").collect()]
    flat = [r["c"] for r in ordered.cum_flat_gap(df, ["k"], "t", {"c": "v"}).orderBy("t").collect()]
    assert lin == [1.0, None, 3.0] and flat == [1.0, 1.0, 3.0]


def test_friday_of_the_week(spark):
    days = {D(2024, 3, 1): D(2024, 3, 1), D(2024, 3, 2): D(2024, 3, 8), D(2024, 3, 7): D(2024, 3, 8)}
    for day, want in days.items():
        assert one(spark, ordered.week_ending_friday(F.col("d")), d=day) == want


def test_ols_guards_and_numpy(spark):
    rows = [("few", 1.0, 2.0), ("few", 2.0, 3.0)] + [("flat", 1.0, float(i)) for i in range(5)]
    rng = np.random.default_rng(1)
    x = rng.normal(size=50)
    y = 3 * x + rng.normal(size=50)
    rows += [("ok", float(a), float(b)) for a, b in zip(x, y)]
    got = {r["g"]: r for r in stats.ols(spark.createDataFrame(rows, ["g", "x", "y"]), ["g"], "x", "y").collect()}
    assert got["few"]["slope"] is None and got["flat"]["slope"] is None
    slope, intercept = np.polyfit(x, y, 1)
    resid = y - slope * x - intercept
    se = np.sqrt((resid @ resid) / 48 / ((x - x.mean()) ** 2).sum())
    assert got["ok"]["slope"] == pytest.approx(slope) and got["ok"]["tstat"] == pytest.approx(slope / se)
    assert got["ok"]["r2"] == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2)
