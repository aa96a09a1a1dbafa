"""How often the quotes are read."""

import datetime as dt

import pytest

from realcurve.operators import cmt, exports, incremental, pairs, walk
from realcurve.plans.panel import Panel
from realcurve.streaming import recompute


@pytest.fixture(scope="module")
def panel(spark, sf_dir):
    return Panel(spark, sf_dir)


def scans(df, name="lineitem"):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(line.count("parquet") > 0 and f"{name}.parquet" in line for line in plan.split("\n"))


def test_bucket_series_reads_the_quotes_once(panel):
    assert scans(cmt.bucket_series(panel.returns_of(cmt.needed_bonds(panel.matched)), panel.matched, panel.tagged)) == 1


def test_pairs_read_the_quotes_once(panel):
    assert scans(panel.pair_returns) == 1


def test_a_pair_named_twice_is_one_and_a_hedge_of_many_serves_all(panel):
    twice = panel.pair_map.union(panel.pair_map).union(panel.pair_map.selectExpr("real_id", "1 AS nominal_id", "beta", "note").limit(3))
    returns = panel.land(panel.bond_returns)
    got = pairs.pair_inner(returns, pairs.scan_pair_map(twice)).groupBy("real_id", "nominal_id", "date").count()
    assert got.where("count > 1").count() == 0
    for r in twice.select("real_id", "nominal_id").distinct().collect():
        both = returns.where(f"bond_id = {r.real_id}").select("date").intersect(returns.where(f"bond_id = {r.nominal_id}").select("date")).count()
        found = got.where(f"real_id = {r.real_id} AND nominal_id = {r.nominal_id}").count()
        assert found in (0, both)


def test_a_walk_of_the_store_shuffles_its_quotes_once_and_keeps_no_value_that_follows(spark, panel, tmp_path):
    rules = panel.land(walk.bounded_rules(walk.bond_rules(panel.bonds, panel.conv, panel.series), panel._foreign_days))
    store = recompute.ReturnStore(spark, f"{tmp_path}/store", lambda q: walk.value_quotes(q, rules, panel._foreign_days), buckets=4)
    store.build(panel.quotes)
    kept = store.tables["returns"].read()
    assert not {"V", "dV", "pnl", "financing", "bp", "gross_bp", "notional", "dirty_real"} & set(kept.columns) and store.read().columns == walk.RETURN_COLUMNS
    seeds = incremental.marks_of(kept).where("1 = 0")
    plan = store._walk(store.tables["quotes"].read(), seeds)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and "bucket" in shuffles[0]


def test_the_pool_looks_up_ids_and_the_events_of_a_bucket_series_are_read_once(panel):
    assert scans(panel.pool) == 0 and scans(panel.held, "orders") == 0
    assert scans(cmt.bucket_series(panel.returns_of(cmt.needed_bonds(panel.matched)), panel.matched, panel.tagged), "orders") == 1


def test_sales_of_a_day_tell_whether_the_held_bond_is_among_them(spark):
    day = lambda m, d: dt.date(2001, m, d)
    tagged = spark.createDataFrame([("M", "5y", 1, day(1, 5), 0.5), ("M", "5y", 2, day(1, 5), 0.25), ("M", "5y", 2, day(1, 5), 0.25), ("M", "5y", 2, day(1, 9), 1.0), ("M", "5y", 1, day(2, 5), 1.0), ("N", "5y", 1, day(1, 5), 1.0)], "market string, bucket string, bond_id long, event_date date, amt_bn double")
    matched = spark.createDataFrame([("M", "5y", day(1, 1), 1), ("M", "5y", day(2, 1), 2)], "market string, bucket string, month date, bond_id long")
    got = {(r.market, r.date): (r.auction_bonds, r.auction_amount, r.auction_is_held) for r in cmt.auction_flags(tagged, matched).collect()}
    assert got == {("M", day(1, 5)): (2, 1.0, True), ("M", day(1, 9)): (1, 1.0, False), ("M", day(2, 5)): (1, 1.0, False), ("N", day(1, 5)): (1, 1.0, None)}


def test_a_page_reads_the_returns_and_the_pairs_once(spark, panel):
    ratios = spark.createDataFrame([], "market string, bucket string, crude_b double")
    page = exports.market_series(panel.buckets, panel.linked_returns, panel.pair_levels, panel.crude, ratios)
    assert scans(page) == 2
    assert "nominal_V" not in panel.pair_levels.columns and "nominal_V" in panel.pair_returns.columns
