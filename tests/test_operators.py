"""Small literal tables for the walk, rolls, anchors, futures and robust fits."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from realcurve.operators import calendars, cmt, futures, incremental, issuance, refindex, robust, rolls, seasonal, walk
from realcurve.sources import cleaning, conventions as cv

D = dt.date


def weekdays(lo, hi):
    return [lo + dt.timedelta(i) for i in range((hi - lo).days + 1) if (lo + dt.timedelta(i)).weekday() < 5]


@pytest.fixture(scope="module")
def market(spark):
    """One calendar, a 3 percent rate, an index with March 2000 unpublished."""
    days = [d for d in weekdays(D(1999, 11, 1), D(2000, 8, 31)) if d != D(2000, 5, 1)]
    rows = [(s, d, 3.0) for s in ("fed_funds", "eonia", "sonia_gc") for d in days]
    month = D(1999, 7, 31)
    for i in range(12):
        if not (month.year == 2000 and month.month == 3):
            rows.append(("UK_RPI", month, 100.0 + i))
        month = (month.replace(day=28) + dt.timedelta(10)).replace(day=28)
        month = (month + dt.timedelta(4)).replace(day=1) - dt.timedelta(1)
    series = spark.createDataFrame(rows, "series_id string, date date, value double")
    return series, calendars.trading_calendar(series)


def bond(spark, conv="UK_3M", **over):
    row = dict(bond_id=1, conv_id=conv, static_freq=2, coupon=4.0, dated=D(1999, 11, 15), maturity=D(2009, 11, 15), base_index=100.0)
    row.update(over)
    return spark.createDataFrame([tuple(row.values())], list(row))


def walked(spark, market, conv, days):
    series, calendar = market
    quotes = spark.createDataFrame([(1, d, 100.0 + 0.01 * i, 4.0, None) for i, d in enumerate(days)], "bond_id int, date date, clean double, ytm double, vendor_ir double")
    table = cv.conventions(spark)
    rules = walk.bond_rules(bond(spark, conv), table, series)
    days_dim = refindex.market_days(table.where(F.col("conv_id") == conv), series, calendar)
    return {r["date"]: r for r in walk.bond_walk(walk.value_quotes(quotes, rules, days_dim)).collect()}


def test_span_and_holiday(spark, market):
    days = weekdays(D(2000, 4, 17), D(2000, 5, 12))
    got = walked(spark, market, "NOM_GB", days)
    assert days[0] not in got  # no previous mark
    assert got[D(2000, 4, 20)]["days"] == 1
    assert got[D(2000, 4, 28)]["days"] == 4   # Friday settles Tuesday: the Monday is closed
    assert got[D(2000, 5, 1)]["days"] == 0    # quoted on the holiday: settles with Friday's quote
    r = got[D(2000, 4, 28)]
    assert r["financing"] == pytest.approx(4 / 360 * 0.03 * r["V_prev"])
    assert r["bp"] == pytest.approx(r["gross_bp"] - r["fin_bp"])


def test_coupon_books_in_settle_span(spark, market):
    got = walked(spark, market, "NOM_GB", weekdays(D(2000, 5, 2), D(2000, 5, 19)))
    paid = {d: r["coupon_cash"] for d, r in got.items() if r["is_coupon"]}
    assert paid == {D(2000, 5, 12): pytest.approx(2.0)}  # Friday's quote settles on the coupon Monday


def test_epoch_holds_prior_month_end_dv01(spark, market):
    got = walked(spark, market, "NOM_GB", weekdays(D(2000, 4, 24), D(2000, 5, 12)))
    may = [r["denom"] for d, r in got.items() if d.month == 5]
    assert len(set(may)) == 1 and may[0] == pytest.approx(got[D(2000, 4, 28)]["dv01"])


def test_unpublished_month_drops_rows(spark, market):
    days = weekdays(D(2000, 4, 3), D(2000, 7, 14))
    got = walked(spark, market, "UK_3M", days)
    # settlements in May and June need the missing March print
    assert not any(D(2000, 5, 1) < d < D(2000, 6, 29) for d in got)
    assert any(d.month == 7 for d in got) or any(d.month == 4 for d in got)


def test_collapse_keeps_latest_issue_and_drops_repeats(spark):
    rows = [("linked", "5y", D(2000, 1, 3), D(1999, 1, 1), 1, None), ("linked", "5y", D(2000, 1, 3), D(1999, 6, 1), 2, None),
            ("linked", "5y", D(2000, 2, 1), D(1999, 6, 1), 2, None), ("linked", "5y", D(2000, 3, 1), D(2000, 2, 1), 3, None)]
    df = spark.createDataFrame(rows, "leg string, tenor string, eff date, issue_date date, bond_id int, maturity_date date")
    got = [(r["eff"], r["bond_id"]) for r in rolls.collapse_rolls(df).orderBy("eff").collect()]
    assert got == [(D(2000, 1, 3), 2), (D(2000, 3, 1), 3)]


def test_matched_nominal_prefers_on_or_after(spark):
    lk = spark.createDataFrame([("linked", "10y", D(2000, 2, 1), D(2000, 1, 15), 10, D(2010, 1, 15))], "leg string, tenor string, eff date, issue_date date, bond_id int, maturity_date date")
    nom = [(1, D(1999, 11, 15), D(2009, 11, 15)), (2, D(1999, 8, 15), D(2010, 2, 14)), (3, D(2000, 2, 15), D(2010, 1, 15)), (4, D(1999, 9, 1), D(2010, 2, 14))]
    issues = spark.createDataFrame([("nominal", "10y", i, d, m) for i, d, m in nom], "leg string, tenor string, bond_id int, issue_date date, maturity_date date")
    got = {r["eff"]: r["bond_id"] for r in rolls.roll_nominal_matched(issues, lk).collect()}
    assert got[D(2000, 2, 1)] == 4       # later issue of the two equal gaps; the closest is not issued yet
    assert got[D(2000, 3, 1)] == 3       # exact maturity, issued by then


def test_closest_nominal_against_brute_force(spark):
    rng = np.random.default_rng(3)
    day = lambda n: D(2000, 1, 1) + dt.timedelta(int(n))
    pool = [(i, "FR", day(rng.integers(400, 6000)), day(rng.integers(-900, 300))) for i in range(60)]
    targets = [("M", "5y", D(2000, m, 1), 100 + m, day(rng.integers(400, 6000)), "FR") for m in range(1, 13)]
    pdf = spark.createDataFrame(pool, "bond_id int, country string, maturity date, issue date")
    tdf = spark.createDataFrame(targets, "market string, bucket string, month date, bond_id int, maturity date, country string")
    got = {r["month"]: r["nominal_id"] for r in cmt.closest_nominal(tdf, pdf).collect()}
    for _, _, month, _, mat, _ in targets:
        alive = [p for p in pool if p[3] <= month - dt.timedelta(1) and p[2] > month]
        want = min(alive, key=lambda p: (abs((p[2] - mat).days), p[2], p[0]))[0]
        assert got[month] == want


@pytest.mark.parametrize("auction, kind", [(D(2000, 3, 3), "early"), (D(2000, 3, 27), "late"), (D(2000, 3, 15), None)])
def test_anchor_clamps(spark, market, auction, kind):
    anchors = spark.createDataFrame([(D(2000, 3, 1), auction, True)], "month date, auction date, new_issue boolean")
    r = seasonal.month_anchors(anchors, market[1]).first()
    assert r["kind"] == kind and r["a0"] == D(2000, 2, 29) and r["a4"] == D(2000, 3, 31)
    assert (r["a1"] == r["a0"]) == (kind == "early") and (r["a3"] == r["a4"]) == (kind == "late")


def test_seasonal_null_day_wins_and_empty_period_stays(spark, market):
    days = [(d, None if d == D(2000, 3, 9) else 1.0) for d in weekdays(D(2000, 3, 1), D(2000, 3, 31))]
    ret = spark.createDataFrame([("5y", d, v, 0.0, 0.1, 0.1) for d, v in days], "tenor string, date date, r_linked_bp double, r_nominal_bp double, s_linked double, s_nominal double")
    anchors = seasonal.month_anchors(spark.createDataFrame([(D(2000, 3, 1), D(2000, 3, 27), True)], "month date, auction date, new_issue boolean"), market[1])
    got = {r["period"]: r for r in seasonal.seasonal_table(ret, anchors).collect()}
    assert got[1]["linked_pnl"] is None and got[1]["nominal_pnl"] == 0.0
    assert got[4]["trading_days"] == 0 and got[4]["linked_pnl"] is None
    assert sum(r["trading_days"] for r in got.values()) == len(days)


def test_step_ups_skip_flat_history(spark):
    rows = [(1, D(2000, 1, i + 1), v * 1e9) for i, v in enumerate((1.0, 1.0, 1.04, 1.5))] + [(2, D(2000, 1, i + 1), 1e9) for i in range(4)]
    got = issuance.step_ups(spark.createDataFrame(rows, "bond_id int, date date, amount double")).collect()
    assert [(r["bond_id"], r["event_date"]) for r in got] == [(1, D(2000, 1, 4))]


def test_month_roll_without_second_is_skipped_but_still_previous(spark, market):
    days = [D(2000, 2, 28), D(2000, 2, 29), D(2000, 3, 1), D(2000, 3, 2)]
    fut = spark.createDataFrame([(d, 50.0 + i, None if d == D(2000, 2, 29) else 60.0, None, None) for i, d in enumerate(days)],
                                "date date, front double, second double, front_gen date, second_gen date")
    got = {r["date"]: r for r in futures.futures_splice_month(fut, market[1]).collect()}
    assert D(2000, 3, 1) not in got and got[D(2000, 3, 2)]["prior_mark"] == 52.0
    assert got[D(2000, 2, 29)]["usd_per_contract"] == pytest.approx(420.0)


def test_topup_new_wins_and_old_columns_stay(spark):
    old = spark.createDataFrame([(1, 1, 10.0, 5.0), (1, 2, 11.0, 6.0)], ["bond_id", "date", "clean", "extra"])
    new = spark.createDataFrame([(1, 2, 12.0), (1, 3, 13.0)], ["bond_id", "date", "clean"])
    got = {r["date"]: (r["clean"], r["extra"]) for r in incremental.topup_merge(old, new).collect()}
    assert got == {1: (10.0, 5.0), 2: (12.0, 6.0), 3: (13.0, None)}


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=400)
    y = 2.0 * x + 0.5 + 0.1 * rng.normal(size=400)
    y[:40] += 15.0 * np.sign(x[:40])
    rows = [("g", D(2000, 1, 1) + dt.timedelta(i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "g string, date date, x double, y double"), x, y


def test_robust_lines_resist_outliers(cloud):
    p, x, y = cloud
    for fit in (robust.huber_fit, robust.median_fit, robust.theil_sen, robust.ransac):
        extra = {"eps": 1e-3} if fit is robust.median_fit else {}
        r = fit(p, ["g"], **extra).first()
        assert r["slope"] == pytest.approx(2.0, abs=0.25), fit.__name__
    assert robust.fit(p, ["g"]).first()["slope"] == pytest.approx(np.polyfit(x, y, 1)[0])


def test_influence_matches_leave_one_out(cloud):
    p, x, y = cloud
    got = {r["date"]: r for r in robust.influence_points(p, ["g"]).collect()}
    n = len(x)
    full = np.polyfit(x, y, 1)
    mse = ((y - np.polyval(full, x)) ** 2).sum() / (n - 2)
    for i in (0, 17, 200):
        keep = np.arange(n) != i
        part = np.polyfit(x[keep], y[keep], 1)
        cook = ((np.polyval(full, x) - np.polyval(part, x)) ** 2).sum() / (2 * mse)
        row = got[D(2000, 1, 1) + dt.timedelta(i)]
        assert row["cooks_d"] == pytest.approx(cook, rel=1e-6)
        s_out = ((y[keep] - np.polyval(part, x[keep])) ** 2).sum() / (n - 3)
        assert row["rstudent"] == pytest.approx((y[i] - np.polyval(full, x[i])) / np.sqrt(s_out * (1 - row["h"])), rel=1e-6)


def test_coupon_forms(spark):
    forms = {"1.25%": 1.25, "0 5/8%": 0.625, "¾%": 0.75, "2½%": 2.5, "1/8%": 0.125, "4 1/8%": 4.125}
    df = spark.createDataFrame([(k,) for k in forms], ["t"]).select("t", cleaning.parse_coupon(F.col("t")).alias("v"))
    assert {r["t"]: r["v"] for r in df.collect()} == forms


def test_hot_key_collapses_before_the_shuffle(spark):
    """A key with a third of the rows reaches the exchange as one row per task and day."""
    rows = spark.range(0, 30000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).alias("bond_id"), F.lit("M").alias("market"),
        F.date_add(F.lit(D(2000, 1, 1)), (F.col("id") % 50).cast("int")).alias("event_date"), F.lit("new").alias("type"), F.lit(1.0).alias("amt_bn"))
    got = issuance.market_months(rows).agg(F.sum("events")).first()[0]
    assert got == 30000
    plan = issuance.market_months(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange")  # printed top-down: the partial step sits below the exchange
