"""Futures, hedge ratios, robust battery, hedged exports, streaming top-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from realcurve.functions import financing as fin
from realcurve.functions import stats
from realcurve.operators import calendars, exports, futures, hedge, lines, robust, walk
from realcurve.plans.panel import PAIR_DAYS_PER_YEAR
from realcurve.sources import driver_tables as src
from realcurve.streaming import recompute, topup

from .ctes import ols
from .registry import case

T = ["tenor"]

# ------------------------------------------------------------------ futures
_FSPEC = "date:d front:4 prior_mark:4 days is_roll chg:4 usd_per_contract:3 r_bp:4 cum_bp:3"
case("futures_splice_month", _FSPEC, lambda p: p.gasoline, "SELECT * FROM gas_spl")
case("futures_splice_ticker", _FSPEC, lambda p: p.crude, "SELECT * FROM crude_spl")
case("naive_vs_spliced", "date:d days r_bp:4 naive_r_bp:4", lambda p: futures.naive_vs_spliced(p.futures, p.gasoline),
     "SELECT g.date, g.days, g.r_bp, n.x AS naive_r_bp FROM gas_spl g JOIN (SELECT date, (front - lag(front) OVER (ORDER BY date)) / lag(front) OVER (ORDER BY date) * 1e4 AS x FROM fx_fut) n USING (date) WHERE is_roll")
case("calendar_intersect", "date:d front:4", lambda p: calendars.calendar_intersect(p.futures, p.calendar, "US"), "SELECT * FROM fx_fut WHERE date IN (SELECT date FROM us_cal)")
case("crude_monthly", "month:d crude_usd:3", lambda p: futures.crude_monthly(p.crude), "SELECT CAST(date_trunc('month', date) AS DATE) AS month, sum(usd_per_contract) AS crude_usd FROM crude_spl GROUP BY 1")

# ------------------------------------------------------------------ aligned pairs and ratios
case("bucket_to_next_day", "tenor date:d r_linked_bp:4 r_nominal_bp:4", lambda p: hedge.bucket_to_next_day(p.tenors, p.gasoline, T, ["r_linked_bp", "r_nominal_bp"]),
     "SELECT r.tenor, f.date, sum(r_linked_bp) AS r_linked_bp, sum(r_nominal_bp) AS r_nominal_bp FROM tenor_rets r ASOF JOIN gas_spl f ON r.date <= f.date GROUP BY 1, 2")
_K = "x_k:4 linked_m:4 nominal_m:4 be_m:4"


def _scaled(df):
    """Dollars in thousands and millions, so that rounding shows the same digits on both engines."""
    return df.withColumns({"x_k": F.col("x_usd") / 1e3, "linked_m": F.col("linked_usd") / 1e6, "nominal_m": F.col("nominal_usd") / 1e6, "be_m": F.col("be_usd") / 1e6})


_KSQL = "x_usd / 1e3 AS x_k, linked_usd / 1e6 AS linked_m, nominal_usd / 1e6 AS nominal_m, be_usd / 1e6 AS be_m"
case("aligned_pairs", "tenor date:d " + _K, lambda p: _scaled(p.pairs_gas), f"SELECT tenor, date, {_KSQL} FROM pairs_gas")
case("aligned_pairs_crude", "tenor date:d " + _K, lambda p: _scaled(p.pairs_crude), f"SELECT tenor, date, {_KSQL} FROM pairs_crude")
case("aligned_pairs_bucket", "market bucket date:d " + _K, lambda p: _scaled(p.pairs_buckets), f"SELECT market, bucket, date, {_KSQL} FROM pairs_bk")
case("trailing_window", "tenor month:d window rows:i first_day:d", lambda p: hedge.window_moments(hedge.complete(p.pairs_gas), T),
     'SELECT tenor, month, win AS "window", count(*) AS rows, min(date) AS first_day FROM wf_rows GROUP BY 1, 2, 3')
_WF = "max(CASE WHEN win = '{w}' THEN slope END) AS contracts_{w}, max(CASE WHEN win = '{w}' THEN r2 END) AS r2_{w}, max(CASE WHEN win = '{w}' THEN corr END) AS corr_{w}, max(CASE WHEN win = '{w}' THEN tstat END) AS tstat_{w}, coalesce(max(CASE WHEN win = '{w}' THEN n END), 0) AS n_{w}"
case("walk_forward_ratio", "tenor month:d rebalance:d contracts_2y:3 r2_2y:5 corr_2y:5 tstat_2y:4 n_2y:i contracts_5y:3 r2_5y:5 tstat_5y:4 n_5y:i", lambda p: hedge.walk_forward_ratio(p.pairs_gas, T, per_year=PAIR_DAYS_PER_YEAR),
     f"SELECT tenor, month, rebalance, {_WF.format(w='2y')}, {_WF.format(w='5y')} FROM wf GROUP BY 1, 2, 3")
# the driver panel has few days with both legs, so the same walk-forward also runs on the linked leg alone
_linked_pairs = lambda p: hedge.aligned_pairs(p.tenors.withColumn("r_nominal_bp", F.lit(0.0)), p.gasoline, T)
case("walk_forward_linked", "tenor month:d contracts_2y:3 r2_2y:5 tstat_2y:4 n_2y:i", lambda p: hedge.walk_forward_ratio(_linked_pairs(p), T, {"2y": 2}, 30),
     f"""WITH q AS (SELECT tenor, f.date, any_value(f.usd_per_contract) AS x_usd, sum(r_linked_bp) * 100000.0 AS y FROM tenor_rets r ASOF JOIN gas_spl f ON r.date <= f.date WHERE r_linked_bp IS NOT NULL GROUP BY 1, 2),
     m AS (SELECT tenor, CAST(date_trunc('month', date) AS DATE) AS month, min(date) AS r FROM q GROUP BY 1, 2),
     j AS (SELECT q.*, m.month, m.r FROM q JOIN m ON m.tenor = q.tenor AND q.date >= CAST(m.r - to_months(24) AS DATE) AND q.date < m.r)
     SELECT tenor, month, slope AS contracts_2y, r2 AS r2_2y, tstat AS tstat_2y, n AS n_2y FROM (SELECT tenor, month, r, min(date) AS lo, {ols('x_usd', 'y')} FROM j GROUP BY 1, 2, 3) WHERE n >= 60 AND lo <= CAST(r - to_months(22) AS DATE)""")
case("walk_forward_leg_betas", "tenor month:d b_linked_2y:3 b_nominal_2y:3 n_2y:i b_linked_5y:3 b_nominal_5y:3 n_5y:i", lambda p: p.leg_betas, "SELECT * FROM wf_legs")
_FB = f"{ols('x_usd', 'linked_usd', 'l_')}, {ols('x_usd', 'nominal_usd', 'u_')}, {ols('x_usd', 'be_usd', 'b_')}"
case("full_sample_betas", "tenor n:i b_linked:3 b_nominal:3 be_beta:3 be_r2:5 be_t:4", lambda p: hedge.full_sample_betas(p.pairs_gas, T),
     f"SELECT tenor, b_n AS n, l_slope AS b_linked, u_slope AS b_nominal, b_slope AS be_beta, b_r2 AS be_r2, b_tstat AS be_t FROM (SELECT tenor, {_FB} FROM pairs_gas GROUP BY 1) WHERE b_n >= 1")
case("mart_hedge", "market bucket n:i b_linked:3 b_nominal:3 be_beta:3 be_r2:5 be_t:4 out_r2:5", lambda p: hedge.full_sample_betas(p.pairs_buckets, ["market", "bucket"], 30),
     f"""SELECT market, bucket, b_n AS n, l_slope AS b_linked, u_slope AS b_nominal, b_slope AS be_beta, b_r2 AS be_r2, b_tstat AS be_t, l_r2 AS out_r2
     FROM (SELECT market, bucket, {_FB} FROM pairs_bk GROUP BY 1, 2) WHERE b_n >= 30""")
_HD = "(SELECT *, bl - 0.75 * bn AS contracts FROM hedged_days)"
case("daily_hedge", "tenor date:d contracts:3 gas_usd:3", lambda p: hedge.daily_hedge(p.tenors, p.hedge_2y, p.gasoline, 0.75), f"SELECT tenor, date, contracts, gas AS gas_usd FROM {_HD}")


def _static_days(p):
    return hedge.daily_hedge(p.tenors, hedge.static_hedge(p.tenors.select("tenor", F.trunc("date", "month").alias("month"))), p.gasoline)


_FULL = "(VALUES " + ", ".join(f"('{t}', {a}, {b})" for t, (a, b) in hedge.FULL_HEDGE.items()) + ") h(t, bl, bn)"
_SD = f"""(SELECT r.*, CAST(h.bl AS DOUBLE) AS bl, CAST(h.bn AS DOUBLE) AS bn, coalesce(g.usd_per_contract, 0.0) AS gas, r_linked_bp - 0.75 * r_nominal_bp AS r_be75_bp FROM tenor_rets r JOIN {_FULL} ON h.t = r.tenor LEFT JOIN gas_spl g ON g.date = r.date)"""
case("hedged_returns", "tenor date:d r_be75_bp:4 r_be100_hedged_bp:4 r_be75_hedged_bp:4 cum_be100_hedged_bp:3 cum_be75_bp:3 cum_be75_hedged_bp:3", lambda p: hedge.hedged_returns(_static_days(p)),
     f"""WITH d AS (SELECT tenor, date, r_be75_bp, r_be_bp - (bl - bn) * gas / 1e5 AS r_be100_hedged_bp, r_be75_bp - (bl - 0.75 * bn) * gas / 1e5 AS r_be75_hedged_bp FROM {_SD})
     SELECT *, CASE WHEN r_be100_hedged_bp IS NOT NULL THEN sum(r_be100_hedged_bp) OVER w END AS cum_be100_hedged_bp, CASE WHEN r_be75_bp IS NOT NULL THEN sum(r_be75_bp) OVER w END AS cum_be75_bp,
     CASE WHEN r_be75_hedged_bp IS NOT NULL THEN sum(r_be75_hedged_bp) OVER w END AS cum_be75_hedged_bp FROM d WINDOW w AS (PARTITION BY tenor ORDER BY date)""")
case("beta_breakeven", "tenor date:d mid_bp:4 long_bp:4 short_bp:4", lambda p: fin.beta_breakeven(_static_days(p), 0.8, 2.0, 1.5),
     f"""SELECT tenor, date, be - hg AS mid_bp, be - slip - hg AS long_bp, -be - slip + hg AS short_bp FROM (SELECT tenor, date, r_linked_bp - 0.8 * r_nominal_bp AS be, 2.0 * s_linked + 0.8 * 1.5 * s_nominal AS slip, (bl - 0.8 * bn) * gas / 1e5 AS hg FROM {_SD})""")
case("monthly_table", "tenor period r_linked_bp:3 mid_bp:3 long_bp:3 short_bp:3", lambda p: exports.monthly_table(fin.beta_breakeven(_static_days(p), 0.8, 2.0, 1.5), ["r_linked_bp", "mid_bp", "long_bp", "short_bp"]),
     f"""WITH d AS (SELECT tenor, date, r_linked_bp, be - hg AS mid_bp, be - slip - hg AS long_bp, -be - slip + hg AS short_bp FROM (SELECT tenor, date, r_linked_bp, r_linked_bp - 0.8 * r_nominal_bp AS be, 2.0 * s_linked + 0.8 * 1.5 * s_nominal AS slip, (bl - 0.8 * bn) * gas / 1e5 AS hg FROM {_SD}))
     SELECT tenor, strftime(date, '%Y-%m') AS period, sum(r_linked_bp) AS r_linked_bp, sum(mid_bp) AS mid_bp, sum(long_bp) AS long_bp, sum(short_bp) AS short_bp FROM d GROUP BY 1, 2 UNION ALL SELECT tenor, 'TOTAL', sum(r_linked_bp), sum(mid_bp), sum(long_bp), sum(short_bp) FROM d GROUP BY 1""")
_wf75 = lambda p: hedge.walk_forward_ratio(hedge.aligned_pairs(p.tenors, p.gasoline, T, 0.75), T, per_year=PAIR_DAYS_PER_YEAR)
_B = """(WITH r AS (SELECT *, linked_usd - 0.75 * nominal_usd AS be75 FROM wf_rows), a AS (SELECT tenor, month, win, years, reach, count(*) AS n, min(date) AS lo, {a}, {b} FROM r GROUP BY 1, 2, 3, 4, 5)
     SELECT * FROM a WHERE n >= 5 * years AND lo <= reach)""".format(a=ols("x_usd", "be_usd", "h_"), b=ols("x_usd", "be75", "q_"))
_cell = lambda c, w: f"max(CASE WHEN win = '{w}' THEN {c} END)"
case("hedge_table", "tenor month:d be100_2y:3 be100_2y_r2:5 be100_5y:3 be75_2y:3 be75_2y_r2:5 be75_5y:3 n_2y:i n_5y:i", lambda p: hedge.hedge_table(hedge.walk_forward_ratio(p.pairs_gas, T, per_year=PAIR_DAYS_PER_YEAR), _wf75(p)),
     f"""SELECT tenor, month, {_cell('h_slope', '2y')} AS be100_2y, {_cell('h_r2', '2y')} AS be100_2y_r2, {_cell('h_slope', '5y')} AS be100_5y, {_cell('q_slope', '2y')} AS be75_2y, {_cell('q_r2', '2y')} AS be75_2y_r2,
     {_cell('q_slope', '5y')} AS be75_5y, coalesce({_cell('n', '2y')}, 0) AS n_2y, coalesce({_cell('n', '5y')}, 0) AS n_5y FROM {_B} GROUP BY 1, 2""")


def _compare(p):
    a = hedge.walk_forward_ratio(p.pairs_gas, T, per_year=PAIR_DAYS_PER_YEAR).select("tenor", "month", F.col("contracts_2y").alias("a"))
    b = _wf75(p).select("tenor", "month", F.col("contracts_2y").alias("b"))
    return stats.path_corr(a.join(b, ["tenor", "month"]), T, "month", "a", "b")


case("beta_compare", "tenor months:i last_a:3 last_b:3 ratio:4 corr:5", _compare,
     f"""WITH m AS (SELECT tenor, month, {_cell('h_slope', '2y')} AS a, {_cell('q_slope', '2y')} AS b FROM {_B} GROUP BY 1, 2)
     SELECT tenor, count(a) AS months, arg_max(a, month) FILTER (a IS NOT NULL) AS last_a, arg_max(b, month) FILTER (b IS NOT NULL) AS last_b, arg_max(b, month) FILTER (b IS NOT NULL) / arg_max(a, month) FILTER (a IS NOT NULL) AS ratio,
     CASE WHEN count(a) > 2 THEN corr(a, b) END AS corr FROM m GROUP BY 1""")


def _leg_paths(p):
    """Monthly linked and nominal sums of each bucket: a second use of the path statistic."""
    from realcurve.operators.studies import monthly_sum_min10

    m = monthly_sum_min10(p.buckets, ("r_linked_bp", "r_nominal_bp"))
    return stats.path_corr(m, ["market", "bucket"], "month", "r_linked_bp", "r_nominal_bp")


case("path_corr", "market bucket months:i last_a:3 last_b:3 corr:5", _leg_paths,
     """WITH m AS (SELECT market, bucket, date_trunc('month', date) AS month, CASE WHEN count(r_linked_bp) >= 10 THEN sum(r_linked_bp) END AS a, CASE WHEN count(r_nominal_bp) >= 10 THEN sum(r_nominal_bp) END AS b FROM bk_series GROUP BY 1, 2, 3)
     SELECT market, bucket, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS months, arg_max(a, month) FILTER (a IS NOT NULL) AS last_a, arg_max(b, month) FILTER (b IS NOT NULL) AS last_b,
     CASE WHEN count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) > 2 THEN corr(a, b) END AS corr FROM m GROUP BY 1, 2""")

# ------------------------------------------------------------------ robust battery: breakevens of buckets (x in thousands, y in millions)
B = ["market", "bucket"]


def _points(p):
    q = p.pairs_buckets.withColumns({"xs": F.col("x_usd") / 1e3, "ys": F.col("be_usd") / 1e6})
    return robust.points(q, B, "xs", "ys")


_PTS = "(SELECT market, bucket, date, x_usd / 1e3 AS x, be_usd / 1e6 AS y FROM pairs_bk WHERE x_usd IS NOT NULL AND be_usd IS NOT NULL)"
_OLS = f"(SELECT market, bucket, {ols('x', 'y')} FROM {_PTS} GROUP BY 1, 2)"
case("ols", "market bucket n:i slope:5 intercept:5 r2:6 corr:6 tstat:4", lambda p: robust.fit(_points(p), B), f"SELECT * FROM {_OLS}")
_WZ = f"""(SELECT p.market, p.bucket, least(greatest(x, xl), xh) AS x, least(greatest(y, yl), yh) AS y FROM {_PTS} p JOIN (
     SELECT market, bucket, quantile_cont(x, 0.01) AS xl, quantile_cont(x, 0.99) AS xh, quantile_cont(y, 0.01) AS yl, quantile_cont(y, 0.99) AS yh FROM {_PTS} GROUP BY 1, 2) e USING (market, bucket))"""
case("winsor_ols", "market bucket n:i slope:5 intercept:5 r2:6", lambda p: robust.winsor_ols(_points(p), B, 1.0), f"SELECT market, bucket, {ols('x', 'y')} FROM {_WZ} GROUP BY 1, 2")
case("line_r2", "market bucket slope:5 intercept:5 r2:6", lambda p: robust.line_r2(_points(p), robust.winsor_ols(_points(p), B, 1.0).select(*B, "slope", "intercept"), B),
     f"""WITH l AS (SELECT market, bucket, {ols('x', 'y')} FROM {_WZ} GROUP BY 1, 2)
     SELECT market, bucket, any_value(slope) AS slope, any_value(intercept) AS intercept, CASE WHEN regr_syy(y, y) > 0 THEN 1 - sum((y - intercept - slope * x) * (y - intercept - slope * x)) / regr_syy(y, y) END AS r2
     FROM {_PTS} p JOIN l USING (market, bucket) GROUP BY 1, 2""")


def _huber_sql(pts: str) -> str:
    """Rounds of reweighting until a line stands still."""
    return f"""(WITH RECURSIVE q AS (SELECT market, bucket, x, y FROM {pts}),
     h AS (SELECT market, bucket, 0 AS k, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, 1.0::DOUBLE AS moved FROM q GROUP BY 1, 2
       UNION ALL SELECT market, bucket, k + 1, b, my - b * mx, abs(b - b0) / (abs(b) + 1e-9) + abs(my - b * mx - a0) / (abs(my - b * mx) + 1e-3) FROM (
         SELECT *, sxy / sxx AS b FROM (
           SELECT market, bucket, any_value(k) AS k, any_value(b) AS b0, any_value(a) AS a0, any_value(mx) AS mx, any_value(my) AS my, sum(wt * (x - mx) * (y - my)) AS sxy, sum(wt * (x - mx) * (x - mx)) AS sxx FROM (
             SELECT *, sum(wt * x) OVER g / sum(wt) OVER g AS mx, sum(wt * y) OVER g / sum(wt) OVER g AS my FROM (
               SELECT *, CASE WHEN ar <= {lines.HUBER_T} * sc THEN 1.0 ELSE {lines.HUBER_T} * sc / ar END AS wt FROM (
                 SELECT *, quantile_cont(ar, 0.5) OVER g / {lines.MAD_SCALE} AS sc FROM (SELECT q.*, h.k, h.b, h.a, abs(q.y - h.a - h.b * q.x) AS ar FROM q JOIN h USING (market, bucket) WHERE h.moved > 1e-12 AND h.k < 300 AND h.b IS NOT NULL) WINDOW g AS (PARTITION BY market, bucket)) WHERE sc > 1e-12)
             WINDOW g AS (PARTITION BY market, bucket)) GROUP BY 1, 2)))
     SELECT market, bucket, arg_max(b, k) AS slope, arg_max(a, k) AS intercept FROM h GROUP BY 1, 2)"""


def _median_sql(pts: str) -> str:
    """The best of the lines through every two points."""
    return f"""(WITH q AS (SELECT market, bucket, x, y, row_number() OVER (PARTITION BY market, bucket ORDER BY date) AS i FROM {pts}),
     l AS (SELECT u.market, u.bucket, (v.y - u.y) / (v.x - u.x) AS slope, u.y - (v.y - u.y) / (v.x - u.x) * u.x AS intercept FROM q u JOIN q v ON u.market = v.market AND u.bucket = v.bucket AND u.i < v.i AND u.x <> v.x),
     z AS (SELECT l.market, l.bucket, slope, intercept, sum(abs(y - intercept - slope * x)) AS loss FROM l JOIN q USING (market, bucket) GROUP BY 1, 2, 3, 4)
     SELECT market, bucket, arg_min(slope, loss) AS slope, arg_min(intercept, loss) AS intercept, min(loss) AS loss FROM z GROUP BY 1, 2)"""


def _pairs_sql(pts: str) -> str:
    """The median slope of every two points."""
    return f"""(WITH q AS (SELECT *, row_number() OVER (PARTITION BY market, bucket ORDER BY date) AS i FROM {pts}),
     m AS (SELECT u.market, u.bucket, quantile_cont((v.y - u.y) / (v.x - u.x), 0.5) AS slope, count(*) AS pairs FROM q u JOIN q v ON u.market = v.market AND u.bucket = v.bucket AND u.i < v.i AND u.x <> v.x GROUP BY 1, 2)
     SELECT market, bucket, any_value(slope) AS slope, any_value(pairs) AS pairs, quantile_cont(y - slope * x, 0.5) AS intercept FROM q JOIN m USING (market, bucket) GROUP BY 1, 2)"""


_known = lambda df: df.where("slope is not null")  # noqa: E731  groups of one day have no line
case("huber_fit", "market bucket slope:5 intercept:5", lambda p: _known(robust.huber_fit(_points(p), B)), f"SELECT * FROM {_huber_sql(_PTS)} WHERE slope IS NOT NULL")
case("median_fit", "market bucket slope:5 intercept:5 loss:5", lambda p: _known(robust.median_fit(_points(p), B)), f"SELECT * FROM {_median_sql(_PTS)}")
_RANK = "(date - DATE '1970-01-01') * 7919 % 10007, date"
case("theil_sen", "market bucket slope:5 intercept:5 pairs:i", lambda p: _known(robust.theil_sen(_points(p), B)), f"SELECT * FROM {_pairs_sql(_PTS)}")
case("theil_sen_full", "market bucket slope:5 intercept:5 pairs:i", lambda p: robust.theil_sen_full(_points(p), B),
     f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY market, bucket ORDER BY {_RANK}) AS rk FROM {_PTS}),
     z AS (SELECT market, bucket, count(*) AS n FROM r GROUP BY 1, 2),
     k AS (SELECT market, bucket, n, min(s) AS steps FROM (SELECT *, unnest(range(1, n)) AS s FROM z) WHERE s = n - 1 OR s * n - s * (s + 1) // 2 >= 10000 GROUP BY 1, 2, 3),
     m AS (SELECT a.market, a.bucket, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope, count(*) AS pairs FROM r a JOIN r b ON a.market = b.market AND a.bucket = b.bucket
       JOIN k ON k.market = a.market AND k.bucket = a.bucket WHERE b.rk - a.rk BETWEEN 1 AND steps AND a.x <> b.x GROUP BY 1, 2)
     SELECT market, bucket, any_value(slope) AS slope, any_value(pairs) AS pairs, quantile_cont(y - slope * x, 0.5) AS intercept FROM {_PTS} p JOIN m USING (market, bucket) GROUP BY 1, 2""")
def _ransac_sql(pts: str) -> str:
    return f"""(WITH r AS (SELECT *, row_number() OVER (PARTITION BY market, bucket ORDER BY {_RANK}) - 1 AS rk FROM {pts}),
     a AS (SELECT market, bucket, quantile_cont(y, 0.5) AS mid, count(*) AS n FROM r GROUP BY 1, 2),
     b AS (SELECT market, bucket, any_value(n) AS n, quantile_cont(abs(y - mid), 0.5) AS tol FROM r JOIN a USING (market, bucket) GROUP BY 1, 2),
     d AS (SELECT b.*, CAST(t AS BIGINT) AS trial FROM b, range(0, {robust.RANSAC_TRIALS}) z(t)),
     m AS (SELECT d.market, d.bucket, trial, tol, (q.y - p.y) / (q.x - p.x) AS ms, p.y - (q.y - p.y) / (q.x - p.x) * p.x AS mi FROM d JOIN r p ON p.market = d.market AND p.bucket = d.bucket AND p.rk = (trial * 7919 + 13) % n
       JOIN r q ON q.market = d.market AND q.bucket = d.bucket AND q.rk = (trial * 104729 + 57) % n WHERE p.x <> q.x),
     v AS (SELECT m.market, m.bucket, trial, count(*) AS inliers FROM m JOIN r USING (market, bucket) WHERE abs(y - mi - ms * x) <= tol GROUP BY 1, 2, 3),
     k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, bucket ORDER BY inliers DESC, trial) AS o FROM v) WHERE o = 1)
     SELECT r.market, r.bucket, any_value(inliers) AS inliers, {ols('x', 'y')}
     FROM k JOIN m USING (market, bucket, trial) JOIN r ON r.market = k.market AND r.bucket = k.bucket WHERE abs(y - mi - ms * x) <= tol GROUP BY 1, 2)"""


case("ransac", "market bucket slope:5 intercept:5 inliers:i", lambda p: robust.ransac(_points(p), B), f"SELECT * FROM {_ransac_sql(_PTS)}")
_INF = f"""(WITH m AS (SELECT market, bucket, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) / regr_sxx(y, x) AS slope, regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) AS sse
       FROM {_PTS} GROUP BY 1, 2 HAVING count(*) > 3 AND regr_sxx(y, x) > 0),
     d AS (SELECT p.*, m.* EXCLUDE (market, bucket), 1.0 / n + (x - mx) * (x - mx) / sxx AS h, y - my - slope * (x - mx) AS e FROM {_PTS} p JOIN m USING (market, bucket))
     SELECT *, e * e / (2 * (sse / (n - 2))) * h / ((1 - h) * (1 - h)) AS cooks_d, e / sqrt((sse - e * e / (1 - h)) / (n - 3) * (1 - h)) AS rstudent, (x - mx) * (x - mx) * e * e / ((1 - h) * (1 - h)) AS hc3 FROM d)"""
_infl = lambda p: robust.influence_points(_points(p), B)
case("influence", "market bucket n:i n_cooks:i n_rstud:i n_lev:i hc3_t:4", lambda p: robust.influence(_infl(p), B),
     f"SELECT market, bucket, any_value(n) AS n, count(*) FILTER (cooks_d > 4.0 / n) AS n_cooks, count(*) FILTER (abs(rstudent) > 3) AS n_rstud, count(*) FILTER (h > 6.0 / n) AS n_lev, any_value(slope) / (sqrt(sum(hc3)) / any_value(sxx)) AS hc3_t FROM {_INF} GROUP BY 1, 2")
case("top_influence", "market bucket rank:i date:d x:4 y:4 cooks_d:6", lambda p: robust.top_influence(_infl(p), B),
     f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, bucket ORDER BY cooks_d DESC, date) AS rank FROM {_INF}) WHERE rank <= 8")
case("trim_top_pct", "market bucket date:d cooks_d:6", lambda p: robust.trim_top_pct(_infl(p), B, F.col("cooks_d"), 0.05),
     f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, bucket ORDER BY cooks_d DESC, date) AS rank FROM {_INF}) WHERE rank > floor(n * 0.05::DOUBLE)")
case("trim_curve", "market bucket score share:4 dropped:i slope:5 r2:6", lambda p: robust.trim_curve(_infl(p), B),
     f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY market, bucket ORDER BY cooks_d DESC, date) AS rc, row_number() OVER (PARTITION BY market, bucket ORDER BY abs(rstudent) DESC, date) AS rr FROM {_INF}),
     c AS (SELECT k.*, s.score, s.share, CASE s.score WHEN 'cooks' THEN rc ELSE rr END AS rk FROM k, (SELECT * FROM (VALUES ('cooks'), ('resid')) a(score), (VALUES (0.005::DOUBLE), (0.01::DOUBLE), (0.025::DOUBLE), (0.05::DOUBLE)) b(share)) s)
     SELECT market, bucket, score, share, floor(any_value(n) * share) AS dropped, slope, r2 FROM (SELECT market, bucket, score, share, any_value(c.n) AS nn, {ols('x', 'y')} FROM c WHERE rk > floor(c.n * share) GROUP BY 1, 2, 3, 4) GROUP BY ALL""".replace("floor(any_value(n) * share) AS dropped", "floor(nn * share) AS dropped"))
case("conditional_r2", "market bucket top_pct n:i slope:5 r2:6", lambda p: robust.conditional_r2(_points(p), B),
     f"""WITH e AS (SELECT market, bucket, unnest([50, 25, 10]) AS top_pct, unnest([quantile_cont(abs(x), 0.5), quantile_cont(abs(x), 0.75), quantile_cont(abs(x), 0.9)]) AS edge FROM {_PTS} GROUP BY 1, 2)
     SELECT p.market, p.bucket, top_pct, {ols('x', 'y')} FROM {_PTS} p JOIN e USING (market, bucket) WHERE abs(x) >= edge GROUP BY 1, 2, 3""")
case("outlier_report", "market bucket n:i ols_beta:4 ols_r2:6 hc3_t:4 cooks_pct:4 huber_beta:4 r2_trim1pct:6 r2_top10pct:6",
     lambda p: robust.outlier_report(p.pairs_buckets.withColumns({"x_usd": F.col("x_usd") / 1e3, "be_usd": F.col("be_usd") / 1e6}), B),
     f"""WITH o AS (SELECT * FROM {_OLS} WHERE n >= 30), i AS (SELECT market, bucket, any_value(slope) / (sqrt(sum(hc3)) / any_value(sxx)) AS hc3_t, count(*) FILTER (cooks_d > 4.0 / n) * 100.0 / any_value(n) AS cooks_pct FROM {_INF} GROUP BY 1, 2),
     h AS (SELECT * FROM {_huber_sql(_PTS)}),
     t AS (SELECT market, bucket, {ols('x', 'y')} FROM (SELECT *, row_number() OVER (PARTITION BY market, bucket ORDER BY cooks_d DESC, date) AS rc FROM {_INF}) k WHERE rc > floor(k.n * 0.01::DOUBLE) GROUP BY 1, 2),
     c AS (SELECT p.market, p.bucket, {ols('x', 'y')} FROM {_PTS} p JOIN (SELECT market, bucket, quantile_cont(abs(x), 0.9) AS edge FROM {_PTS} GROUP BY 1, 2) e USING (market, bucket) WHERE abs(x) >= edge GROUP BY 1, 2)
     SELECT o.market, o.bucket, o.n, o.slope AS ols_beta, o.r2 AS ols_r2, i.hc3_t, i.cooks_pct, h.slope AS huber_beta, t.r2 AS r2_trim1pct, c.r2 AS r2_top10pct
     FROM o LEFT JOIN i USING (market, bucket) LEFT JOIN h USING (market, bucket) LEFT JOIN t USING (market, bucket) LEFT JOIN c USING (market, bucket)""")



def _treatments_sql(pts: str) -> str:
    clipped = lambda pct: f"""(SELECT p.market, p.bucket, least(greatest(x, xl), xh) AS x, least(greatest(y, yl), yh) AS y FROM {pts} p JOIN (
       SELECT market, bucket, quantile_cont(x, {pct}) AS xl, quantile_cont(x, 1 - {pct}) AS xh, quantile_cont(y, {pct}) AS yl, quantile_cont(y, 1 - {pct}) AS yh FROM {pts} GROUP BY 1, 2) e USING (market, bucket))"""  # noqa: E731
    own = [("ols", pts), ("winsor1", clipped(0.01)), ("winsor2.5", clipped(0.025))]
    robust_lines = [("huber", _huber_sql(pts)), ("median", _median_sql(pts)), ("theil_sen", _pairs_sql(pts)), ("ransac", _ransac_sql(pts))]
    parts = [f"SELECT market, bucket, '{n}' AS treatment, slope, intercept, r2 FROM (SELECT market, bucket, {ols('x', 'y')} FROM {source} GROUP BY 1, 2)" for n, source in own]
    union = " UNION ALL ".join(f"SELECT market, bucket, '{n}' AS treatment, slope, intercept FROM {source}" for n, source in robust_lines)
    parts.append(f"""SELECT market, bucket, treatment, any_value(slope) AS slope, any_value(intercept) AS intercept, CASE WHEN regr_syy(y, y) > 0 THEN 1 - sum((y - intercept - slope * x) * (y - intercept - slope * x)) / regr_syy(y, y) END AS r2
       FROM {pts} p JOIN ({union}) l USING (market, bucket) GROUP BY 1, 2, 3""")
    return f"(SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE slope IS NOT NULL)"


_TREATED = "treatment slope:5 intercept:5 r2:6"
case("robust_treatments", "market bucket " + _TREATED, lambda p: _known(robust.treatments(_points(p), B)), f"SELECT * FROM {_treatments_sql(_PTS)}")
TENORS = ["product", "span", "tenor"]


def _tenor_points(p):
    """Breakevens of tenors against either product, over all years and the last five."""
    out = None
    for product, pairs in (("gasoline", p.pairs_gas), ("crude", p.pairs_crude)):
        for span, years in (("full", None), ("5y", 5)):
            q = robust.points(pairs.withColumns({"xs": F.col("x_usd") / 1e3, "ys": F.col("be_usd") / 1e6}), T, "xs", "ys", years).withColumns({"product": F.lit(product), "span": F.lit(span)})
            out = q if out is None else out.unionByName(q)
    return out


_TPTS = "(" + " UNION ALL ".join(
    f"""SELECT '{product}/{span}' AS market, tenor AS bucket, date, x_usd / 1e3 AS x, be_usd / 1e6 AS y FROM (SELECT *, max(date) OVER (PARTITION BY tenor) AS till FROM pairs_{table} WHERE x_usd IS NOT NULL AND be_usd IS NOT NULL) WHERE {cut}"""
    for product, table in (("gasoline", "gas"), ("crude", "crude")) for span, cut in (("full", "true"), ("5y", "date >= CAST(till - to_months(60) AS DATE)"))) + ")"
case("robust_treatments_tenor", "product span tenor " + _TREATED, lambda p: _known(robust.treatments(_tenor_points(p), TENORS)),
     f"SELECT split_part(market, '/', 1) AS product, split_part(market, '/', 2) AS span, bucket AS tenor, treatment, slope, intercept, r2 FROM {_treatments_sql(_TPTS)}")

# ------------------------------------------------------------------ hedged exports and payloads
case("tenor_full", "tenor date:d settle:d d:i linked_bond_id nominal_bond_id net_financing_bp:4 r_be_bp:4 is_roll_day is_coupon_day is_weekend_or_holiday_step is_5y_auction is_10y_auction is_30y_auction auction_size_bn:3 usd_gas:3 contracts_be100:4 r_be75_hedged_bp:4",
     lambda p: exports.tenor_full(p.legs, p.auctions, p.gasoline, hedge.static_hedge(p.tenors.select("tenor", F.trunc("date", "month").alias("month")))),
     f"""WITH t AS (SELECT * FROM leg_rets WHERE leg = 'linked'), u AS (SELECT * FROM leg_rets WHERE leg = 'nominal'),
     b AS (SELECT coalesce(t.tenor, u.tenor) AS tenor, coalesce(t.date, u.date) AS date, coalesce(t.settle, u.settle) AS settle, coalesce(t.days, u.days) AS d, t.bond_id AS linked_bond_id, u.bond_id AS nominal_bond_id,
       t.fin_bp - u.fin_bp AS net_financing_bp, t.bp - u.bp AS r_be_bp, t.bp - 0.75 * u.bp AS be75, coalesce(t.is_roll, false) OR coalesce(u.is_roll, false) AS is_roll_day, coalesce(t.is_coupon, false) OR coalesce(u.is_coupon, false) AS is_coupon_day
       FROM t FULL JOIN u ON t.tenor = u.tenor AND t.date = u.date),
     a AS (SELECT auction_date, bool_or(tenor = '5y') AS f5, bool_or(tenor = '10y') AS f10, bool_or(tenor = '30y') AS f30, arg_max(offering, (bond_id, offering)) FILTER (offering IS NOT NULL) AS size FROM real_auc GROUP BY 1)
     SELECT b.*, d > 1 AS is_weekend_or_holiday_step, coalesce(f5, false) AS is_5y_auction, coalesce(f10, false) AS is_10y_auction, coalesce(f30, false) AS is_30y_auction, round(size / 1e9, 3) AS auction_size_bn,
       g.usd_per_contract AS usd_gas, CAST(h.bl - h.bn AS DOUBLE) AS contracts_be100, be75 - (h.bl - 0.75 * h.bn) * coalesce(g.usd_per_contract, 0) / 1e5 AS r_be75_hedged_bp
     FROM b LEFT JOIN a ON a.auction_date = b.date LEFT JOIN gas_spl g ON g.date = b.date LEFT JOIN {_FULL} ON h.t = b.tenor""")


def _view_days(p):
    docs = exports.view_payload(p.tenors, p.gasoline).select("tenor", "year", "n_days", F.explode(F.from_json("payload", "array<struct<date string, rT double, rU double, dd int, g double>>")).alias("d"))
    return docs.select("tenor", "year", "n_days", "d.*")


case("view_payload", "tenor year n_days:i date rT:4 rU:4 dd:i g:2", _view_days,
     """SELECT tenor, year(r.date) AS year, count(*) OVER (PARTITION BY tenor, year(r.date)) AS n_days, CAST(r.date AS VARCHAR) AS date, round(r_linked_bp, 4) AS rT, round(r_nominal_bp, 4) AS rU, coalesce(r.days, 0) AS dd, round(coalesce(g.usd_per_contract, 0), 2) AS g
     FROM tenor_rets r LEFT JOIN gas_spl g USING (date) WHERE r_be_bp IS NOT NULL""")


def _hedge_months(p):
    docs = exports.hedge_payload(p.leg_betas).select("tenor", "window", "months", F.explode(F.from_json("payload", "map<string, array<double>>")).alias("month", "b"))
    return docs.select("tenor", "window", "months", "month", F.col("b")[0].alias("b_linked"), F.col("b")[1].alias("b_nominal"))


case("hedge_payload", "tenor window months:i month b_linked:4 b_nominal:4", _hedge_months,
     """SELECT tenor, win AS "window", count(*) OVER (PARTITION BY tenor, win) AS months, strftime(month, '%Y-%m') AS month, round(l_slope, 4) AS b_linked, round(u_slope, 4) AS b_nominal FROM wf WHERE l_slope IS NOT NULL AND u_slope IS NOT NULL""")

# ------------------------------------------------------------------ streaming
case("topup_stream", "bond_id date:d clean:4 updates:i", lambda p: topup.run_topup_fixture(p.spark, p.sf_dir),
     "SELECT user_id AS bond_id, CAST(ts AS DATE) AS date, arg_max(value, (ts, event_id)) AS clean, count(*) AS updates FROM events GROUP BY 1, 2")
case("topup_windowed", "window_start:d event_type n:i total:2", lambda p: topup.run_windowed_fixture(p.spark, p.sf_dir),
     "SELECT CAST(ts AS DATE) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS total FROM events GROUP BY 1, 2")


def _recomputed(p):
    """Returns after two batches of revisions, the later one first, each walked from the first month it changes."""
    rules = p.land(walk.bounded_rules(walk.bond_rules(p.bonds, p.conv, p.series), p._foreign_days))
    store = recompute.ReturnStore(p.spark, p.land.path(), lambda q: walk.value_quotes(q, rules, p._foreign_days))
    store.build(p.quotes)
    revisions = src.quote_revisions(p.spark, p.sf_dir)
    for batch in (1, 0):
        store.apply(revisions.where(F.col("event_id") % 2 == batch), batch)
    store.expire()
    return store.read()


case("topup_recompute", "bond_id date:d bp:4 denom:6 cum_bp:3 is_coupon", _recomputed, "SELECT * FROM revised_rets")
