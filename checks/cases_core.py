"""Sources, calendars, reference index, pricing and per-bond walk."""

from __future__ import annotations

from pyspark.sql import functions as F

from realcurve.functions import daycount as dc
from realcurve.functions import financing as fin
from realcurve.functions import ordered, pricing
from realcurve.operators import calendars, incremental, issuance, pairs, quality, refindex, walk
from realcurve.sources import conventions as cv
from realcurve.sources import driver_tables as src
from realcurve.sources import landed

from .ctes import label_sql
from .registry import case

# ------------------------------------------------------------------ scans
case("scan_quotes", "bond_id date:d clean:6 ytm:6", lambda p: landed.scan_quotes(p.quotes),
     "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY bond_id) AS n FROM fx_quotes WHERE clean IS NOT NULL AND ytm IS NOT NULL) WHERE n >= 2")
case("scan_static", "bond_id coupon:4 maturity:d accrual_start:d", lambda p: landed.scan_static(landed.raw_static(p.bonds)),
     "SELECT bond_id, coupon, maturity, dated AS accrual_start FROM fx_static")
case("dated_date", "bond_id dated:d", lambda p: landed.dated_date(p.bonds, p.auctions),
     "SELECT b.bond_id, coalesce(arg_min(a.dated_date, a.auction_date), any_value(b.issue)) AS dated FROM fx_static b LEFT JOIN fx_auctions a USING (bond_id) GROUP BY 1")
case("coupon_freq", "bond_id freq", lambda p: walk.bond_rules(p.bonds, p.conv, p.series),
     "SELECT bond_id, coalesce(c.freq, CASE WHEN static_freq > 0 THEN static_freq END, c.freq_default, 2) AS freq FROM fx_static b JOIN fx_conv c ON c.conv_id = b.conv_id")
case("scan_universe", "bond_id market", lambda p: landed.scan_universe(landed.build_universe(p.bonds, p.conv, p.idle)),
     "SELECT bond_id, market FROM fx_static WHERE linked AND NOT deferred AND bond_id % 41 <> 8")
case("build_universe", "bond_id market country program freq deferred", lambda p: landed.build_universe(p.bonds, p.conv, p.idle),
     "SELECT bond_id, market, c.country, c.program, c.freq, (c.deferred OR bond_id % 41 = 8) AS deferred FROM fx_static b JOIN fx_conv c ON c.conv_id = b.market WHERE linked")
case("scan_pair_map", "real_id nominal_id beta:4 note", lambda p: pairs.scan_pair_map(p.pair_map),
     "SELECT bond_id AS real_id, bond_id + 1 AS nominal_id, 1.0 AS beta, 'L' || bond_id || ' vs N' || (bond_id + 1) AS note FROM fx_static WHERE linked")
case("trim_leading_nulls", "bond_id date:d clean:6", lambda p: landed.trim_leading_nulls(landed.padded_quotes(p.quotes), "clean"),
     """WITH q AS (SELECT bond_id, date, CASE WHEN date >= DATE '1996-01-01' OR bond_id % 3 = 0 THEN clean END AS clean FROM fx_quotes),
     f AS (SELECT bond_id, min(date) FILTER (clean IS NOT NULL) AS lo FROM q GROUP BY 1)
     SELECT q.* FROM q JOIN f USING (bond_id) WHERE q.date >= f.lo""")
case("macro_outer_join", "date:d cpi_nsa:6 gcf_treasury:9 sonia_gc:9 eonia:9",
     lambda p: landed.macro_outer_join(p.series, ["cpi_nsa", "gcf_treasury", "sonia_gc", "eonia"]),
     """SELECT date, max(CASE WHEN series_id = 'cpi_nsa' THEN value END) AS cpi_nsa, max(CASE WHEN series_id = 'gcf_treasury' THEN value END) AS gcf_treasury,
     max(CASE WHEN series_id = 'sonia_gc' THEN value END) AS sonia_gc, max(CASE WHEN series_id = 'eonia' THEN value END) AS eonia FROM fx_series
     WHERE series_id IN ('cpi_nsa', 'gcf_treasury', 'sonia_gc', 'eonia') GROUP BY 1""")
case("apply_overrides", "series_id date:d value:6",
     lambda p: incremental.apply_overrides(p.series.where(F.col("series_id").isin(*cv.MONTHLY_INDICES)),
                                           cv.inline(p.spark, ["series_id", "date", "value"], [("UK_RPI", "1998-07-31", 111.5), ("cpi_nsa", "1999-01-31", 112.25)])
                                           .select("series_id", F.col("date").cast("date").alias("date"), F.col("value").cast("double").alias("value"))),
     """SELECT series_id, date, CASE WHEN series_id = 'cpi_nsa' AND date = DATE '1999-01-31' THEN 112.25 ELSE value END AS value FROM fx_series
     WHERE series_id IN ('cpi_nsa', 'EUR_HICPXT', 'FR_CPIXT', 'UK_RPI', 'IT_FOIXT') UNION ALL SELECT 'UK_RPI', DATE '1998-07-31', 111.5""")

# ------------------------------------------------------------------ scalar functions over bonds and quotes
_FREQ = "CASE WHEN bond_id % 3 = 0 THEN 1 ELSE 2 END"


def _gridded(p):
    """Bonds with a month-end variant of the maturity on every fifth id."""
    k = F.col("bond_id")
    mat = F.when(k % 5 == 0, F.last_day("maturity")).otherwise(F.col("maturity"))
    return p.bonds.withColumn("maturity", mat).withColumn("freq", F.when(k % 3 == 0, 1).otherwise(2))


_GB = f"""SELECT bond_id, dated, {_FREQ} AS freq, CASE WHEN bond_id % 5 = 0 THEN last_day(maturity) ELSE maturity END AS maturity FROM fx_static"""
_STEP = """CASE WHEN maturity = last_day(maturity) THEN last_day(CAST(maturity - to_months(CAST(k AS INTEGER)) AS DATE)) ELSE CAST(maturity - to_months(CAST(k AS INTEGER)) AS DATE) END"""
case("shift_months_eom", "bond_id k shifted:d",
     lambda p: _gridded(p).withColumn("k", F.explode(F.array(*[F.lit(i) for i in (1, 6, 13)]))).withColumn("shifted", dc.shift_months_eom(F.col("maturity"), -F.col("k"))),
     f"SELECT bond_id, k, {_STEP} AS shifted FROM ({_GB}), (VALUES (1), (6), (13)) v(k)")
case("pay_dates", "bond_id seq pay_date:d",
     lambda p: _gridded(p).select("bond_id", F.posexplode(dc.pay_dates(F.col("maturity"), F.col("dated"), F.col("freq"))).alias("seq", "pay_date")),
     f"""SELECT bond_id, row_number() OVER (PARTITION BY bond_id ORDER BY d) - 1 AS seq, d AS pay_date FROM (
     SELECT *, {_STEP} AS d FROM (SELECT g.*, unnest([i * (12 // freq) for i in range(0, 130)]) AS k FROM ({_GB}) g)) WHERE d > dated""")


def _schedule(p):
    settle = F.add_months(F.col("dated"), 7)
    prev, future = dc.coupon_schedule(F.col("maturity"), settle, F.col("freq"))
    return _gridded(p).select("bond_id", prev.alias("previous"), F.size(future).alias("n_future"), F.element_at(future, 1).alias("next"), F.element_at(future, -1).alias("last"))


case("coupon_schedule", "bond_id previous:d n_future next:d last:d", _schedule,
     f"""SELECT bond_id, max(d) FILTER (d <= s) AS previous, count(*) FILTER (d > s AND d <= maturity) AS n_future, min(d) FILTER (d > s) AS next, max(d) AS last FROM (
     SELECT *, {_STEP} AS d, CAST(dated + INTERVAL 7 MONTH AS DATE) AS s FROM (SELECT g.*, unnest([i * (12 // freq) for i in range(0, 130)]) AS k FROM ({_GB}) g)) GROUP BY bond_id""")
case("bucket_label", "bond_id date:d years:4 label label_long",
     lambda p: p.quotes.join(p.bonds, "bond_id").withColumn("years", dc.years_between(F.col("maturity"), F.col("date"))).select(
         "bond_id", "date", "years", dc.bucket_label(F.col("years")).alias("label"), dc.bucket_label(F.col("years") + 10, F.lit(True)).alias("label_long")),
     "SELECT bond_id, date, y AS years, " + label_sql("y", None) + " AS label, "
     + label_sql("(y + 10)", "true") + " AS label_long FROM (SELECT q.bond_id, q.date, (maturity - q.date) / 365.25 AS y FROM fx_quotes q JOIN fx_static USING (bond_id))")
case("years_between", "bond_id years:6", lambda p: p.bonds.select("bond_id", dc.years_between(F.col("maturity"), F.col("dated")).alias("years")),
     "SELECT bond_id, (maturity - dated) / 365.25 AS years FROM fx_static")
case("nth_weekday", "month:d nth tuesday:d friday:d",
     lambda p: src.orders(p.spark, p.sf_dir).select(F.trunc("date", "month").alias("month")).distinct().withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(5))))
     .select("month", "nth", *[F.coalesce(*[F.when(F.col("nth") == n, dc.nth_weekday(F.col("month"), d, n)) for n in range(1, 6)]).alias(a) for d, a in (("TUE", "tuesday"), ("FRI", "friday"))]),
     """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS month FROM fx_orders),
     d AS (SELECT month, CAST(month + to_days(CAST(i AS INTEGER)) AS DATE) AS x FROM m, range(0, 31) r(i)),
     n AS (SELECT month, x, isodow(x) AS w, row_number() OVER (PARTITION BY month, isodow(x) ORDER BY x) AS nth FROM d WHERE x <= last_day(month))
     SELECT m.month, v.nth, (SELECT x FROM n WHERE n.month = m.month AND w = 2 AND n.nth = v.nth) AS tuesday, (SELECT x FROM n WHERE n.month = m.month AND w = 5 AND n.nth = v.nth) AS friday
     FROM m, (VALUES (1), (2), (3), (4), (5)) v(nth)""")
case("next_expected_auction", "market as_of:d expected:d days_until due",
     lambda p: calendars.next_expected_auction(p.taps.groupBy("market").agg(F.max("event_date").alias("as_of")), F.col("as_of"), cv.AUCTION_RULES),
     """WITH a AS (SELECT market, max(event_date) AS as_of FROM fx_events WHERE market IN ('FR_OATEI', 'FR_OATI', 'ES_EI', 'IT_BTPEI') GROUP BY 1),
     d AS (SELECT market, as_of, CAST(date_trunc('month', as_of) + to_days(CAST(i AS INTEGER)) AS DATE) AS x FROM a, range(0, 100) r(i)),
     n AS (SELECT *, row_number() OVER (PARTITION BY market, date_trunc('month', x), isodow(x) ORDER BY x) AS nth FROM d),
     e AS (SELECT market, as_of, min(x) AS expected FROM n WHERE x >= as_of AND CASE market WHEN 'ES_EI' THEN isodow(x) = 4 AND nth = 1 WHEN 'IT_BTPEI' THEN isodow(x) = 2 AND nth = 4 ELSE isodow(x) = 4 AND nth = 3 END GROUP BY 1, 2)
     SELECT market, as_of, expected, expected - as_of AS days_until, expected - as_of <= 7 AS due FROM e""")
case("issuer_country", "bond_id issuer", lambda p: landed.issuer_country(landed.raw_static(p.bonds)),
     "SELECT bond_id, country AS issuer FROM fx_static")

# ------------------------------------------------------------------ calendars and reference index
case("trading_calendar", "cal_id date:d seq", lambda p: p.calendar, "SELECT * FROM fx_cal")
case("settle_join", "cal_id settle_lag date:d settle:d n:i",
     lambda p: calendars.settle_join(
         p.quotes.join(p.bonds, "bond_id").join(F.broadcast(p.conv.drop("country", "deferred")), "conv_id").groupBy("cal_id", "settle_lag", "date").agg(F.count(F.lit(1)).alias("n")),
         p.calendar, p.conv.select("cal_id", "settle_lag").distinct()),
     """WITH o AS (SELECT c.cal_id, c.settle_lag, q.date, count(*) AS n FROM fx_quotes q JOIN fx_static b USING (bond_id) JOIN fx_conv c ON c.conv_id = b.conv_id GROUP BY 1, 2, 3)
     SELECT o.*, (SELECT list_sort(list(k.date))[o.settle_lag] FROM fx_cal k WHERE k.cal_id = o.cal_id AND k.date > o.date AND k.date < o.date + 60) AS settle FROM o""")
case("first_bday_on_or_after", "bond_id dated:d bday:d",
     lambda p: calendars.first_bday_on_or_after(p.bonds.select("bond_id", "dated"), p.calendar, "dated", "US"),
     "SELECT bond_id, dated, (SELECT min(date) FROM us_cal WHERE date >= dated) AS bday FROM fx_static")
case("repo_series", "date:d gc:9", lambda p: calendars.dense_rates(calendars.repo_curves(p.series)).where("repo_id = 'us_gc'"),
     "SELECT * FROM gc_days WHERE repo_id = 'us_gc'")
case("repo_extended", "repo_id date:d gc:9", lambda p: calendars.dense_rates(calendars.repo_curves(p.series)).where("repo_id <> 'us_gc'"),
     "SELECT * FROM gc_days WHERE repo_id <> 'us_gc'")
case("ffill", "date:d eonia:9 rfr_it:9",
     lambda p: ordered.ffill(landed.macro_outer_join(p.series, ["eonia", "rfr_it"]).withColumn("k", F.lit("rates")), ["k"], "date", ["eonia", "rfr_it"]),
     """SELECT date, last_value(e IGNORE NULLS) OVER (ORDER BY date) AS eonia, last_value(i IGNORE NULLS) OVER (ORDER BY date) AS rfr_it FROM (
     SELECT date, max(CASE WHEN series_id = 'eonia' THEN value END) AS e, max(CASE WHEN series_id = 'rfr_it' THEN value END) AS i FROM fx_series WHERE series_id IN ('eonia', 'rfr_it') GROUP BY 1)""")
case("asof_rate", "bond_id date:d gc:9",
     lambda p: landed.asof_rate(p.quotes.join(p.bonds.where(~F.col("linked")), "bond_id").join(F.broadcast(p.conv.select("conv_id", "repo_id")), "conv_id").select("bond_id", "date", "repo_id"),
                                calendars.repo_curves(p.series)),
     """SELECT q.bond_id, q.date, r.rate AS gc FROM (SELECT q.bond_id, q.date, c.repo_id FROM fx_quotes q JOIN fx_static b USING (bond_id) JOIN fx_conv c ON c.conv_id = b.conv_id WHERE NOT linked) q
     ASOF LEFT JOIN fx_repo r ON r.repo_id = q.repo_id AND q.date >= r.date""")
case("pct_change", "index_id month:d level:6 mom_pct:6 yoy_pct:6", lambda p: refindex.pct_change(p.series),
     "SELECT *, (level / lag(level) OVER w - 1) * 100 AS mom_pct, (level / lag(level, 12) OVER w - 1) * 100 AS yoy_pct FROM fx_levels WINDOW w AS (PARTITION BY index_id ORDER BY month)")
case("daily_reference_index", "index_id settle:d dri:6",
     lambda p: refindex.daily_reference_index(
         landed.settle_grid(p.calendar, p.conv), p.series).where("lag_months = 3"),
     """SELECT i.index_id, k.date AS settle, a.level + (day(k.date) - 1)::DOUBLE / day(last_day(k.date)) * (b.level - a.level) AS dri
     FROM (SELECT DISTINCT index_id, cal_id FROM fx_conv WHERE index_id IS NOT NULL AND lag_months = 3) i JOIN fx_cal k USING (cal_id)
     LEFT JOIN fx_levels a ON a.index_id = i.index_id AND a.month = date_trunc('month', k.date) - INTERVAL 3 MONTH LEFT JOIN fx_levels b ON b.index_id = i.index_id AND b.month = date_trunc('month', k.date) - INTERVAL 2 MONTH""")
case("index_ratio_us", "bond_id date:d index_ratio:5", lambda p: p.metrics(domestic=True, keep=("linked",)).where("linked"),
     "SELECT bond_id, date, index_ratio FROM mu_metrics WHERE linked")
case("index_ratio_intl", "bond_id date:d index_ratio:5", lambda p: p.metrics(keep=("linked",)).where("linked"),
     "SELECT bond_id, date, index_ratio FROM mx_metrics WHERE linked")
case("ir_crosscheck", "bond_id date:d ir_gap:6", lambda p: refindex.ir_crosscheck(p.bond_returns.where("linked")),
     "SELECT bond_id, date, abs(index_ratio - vendor_ir) AS ir_gap FROM bond_rets WHERE linked")

# ------------------------------------------------------------------ pricing
case("accrued", "bond_id date:d accrued:6", lambda p: p.metrics(), "SELECT bond_id, date, accrued FROM mx_metrics")
case("dirty_price", "bond_id date:d price:4",
     lambda p: p.metrics().withColumn("price", pricing.dirty_price(F.col("ytm"), F.col("w"), F.col("n_left"), F.col("coupon"), F.col("freq"))),
     "SELECT bond_id, date, coupon / f * list_sum([pow(1 + ytm / 100 / f, -(k + w)) for k in range(0, n_left)]) + 100 * pow(1 + ytm / 100 / f, -(n_left - 1 + w)) AS price FROM mx_metrics")
case("dv01", "bond_id date:d dv01:6", lambda p: p.metrics(), "SELECT bond_id, date, dv01 FROM mx_metrics")
# value-by-ratio cells end in exact halves at any decimal, so the valuation shows as modified duration
case("bond_metrics", "bond_id date:d settle:d dirty_real:9 mod_duration:6", lambda p: p.metrics(domestic=True).withColumn("mod_duration", F.try_divide("dv01", "V") * 1e4),
     "SELECT bond_id, date, settle, dirty_real, dv01 / V * 1e4 AS mod_duration FROM mu_metrics")

# ------------------------------------------------------------------ walk
case("lag_mark", "bond_id date:d prev_date:d settle_prev:d v_relative:8", lambda p: walk.lag_mark(p.metrics()).withColumn("v_relative", F.try_divide("V", "V_prev")), "SELECT *, V / V_prev AS v_relative FROM mx_lag")
case("epoch_denom", "bond_id date:d denom:6", lambda p: walk.epoch_denom(walk.lag_mark(p.metrics())), "SELECT * FROM mx_epoch")
case("coupon_in_span", "bond_id date:d paid", lambda p: walk.lag_mark(p.metrics()).where("n_prev > n_left").withColumn("paid", F.col("n_prev") - F.col("n_left")),
     "SELECT bond_id, date, paid FROM mx_lag WHERE paid > 0")
case("bond_walk", "bond_id date:d days coupon_cash:9 fin_bp:4 bp:4 is_coupon", lambda p: p.bond_returns, "SELECT * FROM bond_rets")
case("bond_walk_monthly", "bond_id month:d days:i bp:4 fin_bp:4 coupons:i",
     lambda p: p.bond_returns.groupBy("bond_id", F.trunc("date", "month").alias("month")).agg(
         F.count(F.lit(1)).alias("days"), F.sum("bp").alias("bp"), F.sum("fin_bp").alias("fin_bp"), F.count_if("is_coupon").alias("coupons")),
     "SELECT bond_id, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS days, sum(bp) AS bp, sum(fin_bp) AS fin_bp, count(*) FILTER (is_coupon) AS coupons FROM bond_rets GROUP BY 1, 2")
case("cum_linear", "bond_id date:d cum_bp:3", lambda p: p.bond_returns, "SELECT * FROM bond_rets")
case("leg_financing", "bond_id date:d long_cash:4 short_cash:4",
     lambda p: p.bond_returns.where("gc IS NOT NULL").select("bond_id", "date", *[
         fin.leg_financing(F.col("V_prev"), F.col("days"), F.col("gc"), F.lit(s)).alias(f"{s}_cash") for s in ("long", "short")]),
     "SELECT bond_id, date, -V_prev * (gc + 0.03) / 100 * days / 360.0 AS long_cash, V_prev * (gc - 0.03) / 100 * days / 360.0 AS short_cash FROM bond_rets WHERE gc IS NOT NULL")
case("package_financing", "real_id date:d long_be:4 short_be:4",
     lambda p: p.pair_returns.where("gc IS NOT NULL").select("real_id", "date", *[
         fin.package_financing(F.col("linked_V_prev"), F.col("nominal_V_prev"), F.col("days"), F.col("gc"), F.lit(s)).alias(s) for s in ("long_be", "short_be")]),
     """SELECT real_id, date, (-linked_V_prev * (gc + 0.03) + nominal_V_prev * (gc - 0.03)) / 100 * days / 360.0 AS long_be, (linked_V_prev * (gc - 0.03) - nominal_V_prev * (gc + 0.03)) / 100 * days / 360.0 AS short_be
     FROM pair_rets WHERE gc IS NOT NULL""")
case("pair_inner", "real_id nominal_id date:d linked_bp:4 nominal_bp:4", lambda p: pairs.pair_inner(p.returns_of(pairs.mapped_bonds(p.pair_map)), pairs.scan_pair_map(p.pair_map)), "SELECT * FROM pair_rets")
case("pair_breakeven", "real_id nominal_id date:d v_relative:8 net_fin_bp:4 r_be_bp:4 cum_be_bp:3 is_coupon_day is_weekend_or_holiday_step",
     lambda p: p.pair_returns.withColumn("v_relative", F.try_divide("linked_V", "nominal_V")), "SELECT *, linked_V / nominal_V AS v_relative FROM pair_rets")
case("longest_history_pair", "real_id nominal_id days", lambda p: pairs.longest_history_pair(p.pair_returns),
     "SELECT real_id, nominal_id, count(*) AS days FROM pair_rets GROUP BY 1, 2 ORDER BY days DESC, real_id LIMIT 1")

# ------------------------------------------------------------------ quality and incremental
case("universe_compare", "bond_id seed_coupon:4 static_coupon:4 seed_maturity:d static_maturity:d missing",
     lambda p: quality.universe_compare(p.bonds, landed.partial_static(p.bonds)),
     """SELECT bond_id, coupon AS seed_coupon, CASE WHEN bond_id % 6 <> 1 THEN coupon + CASE WHEN bond_id % 4 = 0 THEN 0.125 ELSE 0 END END AS static_coupon, maturity AS seed_maturity,
     CASE WHEN bond_id % 6 <> 1 THEN maturity END AS static_maturity, bond_id % 6 = 1 AS missing FROM fx_static""")
case("feed_coverage", "ids:i present:i first:d last:d pct", lambda p: quality.feed_coverage(p.bonds, p.quotes.where("bond_id % 7 <> 3")),
     """SELECT count(*) AS ids, count(lo) AS present, min(lo) AS first, max(hi) AS last, CAST(round_even(100.0 * count(lo) / count(*), 0) AS INTEGER) AS pct
     FROM fx_static LEFT JOIN (SELECT bond_id, min(date) AS lo, max(date) AS hi FROM fx_quotes WHERE bond_id % 7 <> 3 GROUP BY 1) USING (bond_id)""")
case("topup_merge", "bond_id date:d clean:6 ytm:6 vendor_ir:6", lambda p: incremental.topup_merge(*landed.revision_split(p.quotes)),
     """SELECT bond_id, date, CASE WHEN date >= DATE '1999-06-01' AND bond_id % 2 = 0 THEN clean + 0.5 ELSE clean END AS clean, ytm, CASE WHEN date < DATE '2000-06-01' OR bond_id % 2 = 1 THEN vendor_ir END AS vendor_ir
     FROM fx_quotes WHERE NOT (bond_id % 2 = 1 AND date >= DATE '2000-06-01')""")
case("topup_start", "bond_id last_date:d start:d", lambda p: incremental.topup_start(p.quotes, p.bonds, F.lit(p.as_of).cast("date"), p.idle),
     "SELECT bond_id, max(q.date) AS last_date, max(q.date) - 7 AS start FROM fx_quotes q JOIN fx_static b USING (bond_id) WHERE maturity > DATE '2001-12-01' AND NOT deferred AND bond_id % 41 <> 8 GROUP BY 1")
case("missing_ids", "bond_id", lambda p: incremental.missing_ids(p.bonds, p.quotes.where("bond_id % 9 <> 4")),
     "SELECT bond_id FROM fx_static WHERE bond_id NOT IN (SELECT bond_id FROM fx_quotes WHERE bond_id % 9 <> 4)")
case("market_matrix", "market country program index_id freq settle_lag cal_id floor quote ccy repo_id lag_months interp deferred bonds:i",
     lambda p: landed.market_matrix(p.bonds),
     """SELECT c.conv_id AS market, c.country, c.program, c.index_id, c.freq, c.settle_lag, c.cal_id, c.floor, c.quote, c.ccy, c.repo_id, c.lag_months, c.interp, c.deferred, count(b.bond_id) AS bonds
     FROM fx_conv c LEFT JOIN fx_static b ON b.market = c.conv_id WHERE c.conv_id NOT LIKE 'NOM%' AND c.conv_id NOT LIKE 'US%' GROUP BY ALL""")
case("universe_counts", "country program bonds:i", lambda p: landed.universe_counts(landed.build_universe(p.bonds, p.conv, p.idle), ["country", "program"]),
     "SELECT c.country, c.program, count(*) AS bonds FROM fx_static b JOIN fx_conv c ON c.conv_id = b.market GROUP BY 1, 2")
