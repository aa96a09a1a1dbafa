"""Rolls, tenor series, invariants and seasonality of the domestic half."""

from __future__ import annotations

from pyspark.sql import functions as F

from realcurve.functions import financing as fin
from realcurve.functions import ordered, stats
from realcurve.operators import exports, quality, rolls, seasonal, walk
from realcurve.sources import conventions as cv
from realcurve.sources import cleaning

from .ctes import LAST_MONTH, ols
from .registry import case

# ------------------------------------------------------------------ auctions and rolls
case("normalize_auctions", "bond_id leg tenor auction_date:d issue_date:d maturity_date:d offering:0",
     lambda p: cleaning.normalize_auctions(cleaning.raw_auction_text(p.auctions)),
     """SELECT bond_id, leg, tenor, auction_date, CASE WHEN bond_id % 9 <> 2 THEN issue_date END AS issue_date, maturity_date, CASE WHEN bond_id % 8 <> 3 THEN offering END AS offering
     FROM (SELECT *, row_number() OVER (PARTITION BY bond_id, auction_date ORDER BY issue_date) AS k FROM fx_auctions WHERE bond_id % 23 <> 5) WHERE k = 1""")
case("issue_date_min", "bond_id issue_date:d", lambda p: p.issue_days, "SELECT * FROM iss_min")
case("maturity_first", "bond_id maturity_date:d", lambda p: rolls.maturity_first(p.auctions), "SELECT bond_id, arg_min(maturity_date, auction_date) AS maturity_date FROM fx_auctions GROUP BY 1")
case("new_issues", "leg tenor bond_id issue_date:d auction_date:d", lambda p: rolls.new_issues(p.auctions), "SELECT * FROM new_iss")
case("real_auctions", "bond_id auction_date:d offering:0", lambda p: rolls.real_auctions(p.auctions), "SELECT * FROM real_auc")
case("otr_schedule", "leg tenor month:d bond_id maturity_date:d auction_date:d", lambda p: p.schedule,
     f"""WITH g AS (SELECT CAST(unnest(generate_series((SELECT CAST(date_trunc('month', min(auction_date)) AS DATE) FROM fx_auctions), {LAST_MONTH}, INTERVAL 1 MONTH)) AS DATE) AS month)
     SELECT * FROM (SELECT a.leg, a.tenor, g.month, a.bond_id, a.maturity_date, a.auction_date, row_number() OVER (PARTITION BY leg, tenor, month ORDER BY auction_date DESC, bond_id DESC) AS k
     FROM g JOIN fx_auctions a ON a.auction_date < g.month) WHERE k = 1""")
_SCHED = f"""(WITH g AS (SELECT CAST(unnest(generate_series((SELECT CAST(date_trunc('month', min(auction_date)) AS DATE) FROM fx_auctions), {LAST_MONTH}, INTERVAL 1 MONTH)) AS DATE) AS month)
     SELECT leg, tenor, month, bond_id FROM (SELECT a.leg, a.tenor, g.month, a.bond_id, row_number() OVER (PARTITION BY leg, tenor, month ORDER BY auction_date DESC, bond_id DESC) AS k
     FROM g JOIN fx_auctions a ON a.auction_date < g.month) WHERE k = 1)"""
case("otr_universe", "bond_id leg tenor", lambda p: rolls.otr_universe(p.schedule), f"SELECT DISTINCT bond_id, leg, tenor FROM {_SCHED}")
case("roll_tips", "leg tenor eff:d issue_date:d bond_id", lambda p: rolls.roll_linked(rolls.new_issues(p.auctions), p.calendar),
     "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY leg, tenor, issue_date ORDER BY bond_id DESC) AS k FROM roll_lk_raw) WHERE k = 1")
case("roll_nominal_boundary", "leg tenor eff:d issue_date:d bond_id",
     lambda p: rolls.roll_nominal_boundary(rolls.new_issues(p.auctions), rolls.collapse_rolls(rolls.roll_linked(rolls.new_issues(p.auctions), p.calendar)).where("tenor <> '10y'")),
     "SELECT * FROM roll_nb")
case("roll_nominal_matched", "leg tenor eff:d issue_date:d bond_id maturity_date:d",
     lambda p: rolls.roll_nominal_matched(rolls.new_issues(p.auctions), rolls.roll_linked(rolls.new_issues(p.auctions), p.calendar)), "SELECT * FROM roll_nm")
case("collapse_rolls", "leg tenor eff:d bond_id", lambda p: p.rolls, "SELECT * FROM roll_sched")
case("roll_effective", "leg tenor bond_id eff:d next_eff:d", lambda p: p.spans, "SELECT * FROM roll_span")
case("current_otr", "leg tenor bond_id eff:d", lambda p: rolls.current_otr(p.rolls), "SELECT leg, tenor, arg_max(bond_id, eff) AS bond_id, max(eff) AS eff FROM roll_sched GROUP BY 1, 2")
case("active_bond", "leg tenor date:d bond_id",
     lambda p: rolls.active_bond(cleaning.days_by_leg(p.calendar, p.spans), p.spans).where("bond_id IS NOT NULL"),
     "SELECT s.leg, s.tenor, c.date, s.bond_id FROM us_cal c JOIN roll_span s ON c.date >= s.eff AND (s.next_eff IS NULL OR c.date < s.next_eff)")
case("leg_walk", "leg tenor date:d bond_id days bp:4 fin_bp:4 is_roll is_coupon", lambda p: p.legs, "SELECT * FROM leg_rets")
case("is_roll", "leg tenor date:d bond_id", lambda p: p.legs.where("is_roll"), "SELECT * FROM leg_rets WHERE is_roll")
case("tenor_returns", "tenor date:d r_linked_bp:4 r_nominal_bp:4 s_linked:6 s_nominal:6 days cum_be_bp:3", lambda p: p.tenors, "SELECT * FROM tenor_rets")
case("legs_outer", "tenor date:d linked_bond_id nominal_bond_id linked_bp:4 nominal_bp:4", lambda p: exports.legs_outer(p.legs),
     """SELECT tenor, date, max(bond_id) FILTER (leg = 'linked') AS linked_bond_id, max(bond_id) FILTER (leg = 'nominal') AS nominal_bond_id,
     max(bp) FILTER (leg = 'linked') AS linked_bp, max(bp) FILTER (leg = 'nominal') AS nominal_bp FROM leg_rets GROUP BY 1, 2""")
case("half_spread", "tenor date:d long_be_bp:4 short_be_bp:4", lambda p: fin.half_spread(p.tenors, 3.0, 2.0),
     "SELECT tenor, date, r_be_bp - (3.0 * s_linked + 2.0 * s_nominal) AS long_be_bp, -r_be_bp - (3.0 * s_linked + 2.0 * s_nominal) AS short_be_bp FROM tenor_rets")
_WT = "SELECT tenor, date, r_linked_bp, r_nominal_bp, r_be_bp, r_be_bp - (3.0 * s_linked + 2.0 * s_nominal) AS long_be_bp, -r_be_bp - (3.0 * s_linked + 2.0 * s_nominal) AS short_be_bp FROM tenor_rets"
_SUMS = "coalesce(sum(r_linked_bp), 0) AS r_linked_bp, coalesce(sum(r_nominal_bp), 0) AS r_nominal_bp, coalesce(sum(r_be_bp), 0) AS r_be_bp, coalesce(sum(long_be_bp), 0) AS long_be_bp, coalesce(sum(short_be_bp), 0) AS short_be_bp"
case("window_table", "tenor period r_linked_bp:4 r_nominal_bp:4 r_be_bp:4 long_be_bp:4 short_be_bp:4", lambda p: exports.window_table(p.tenors, x_linked=3.0, x_nominal=2.0),
     f"""WITH t AS ({_WT}) SELECT tenor, strftime(date, '%Y-%m') AS period, {_SUMS} FROM t WHERE r_linked_bp IS NOT NULL OR r_nominal_bp IS NOT NULL GROUP BY 1, 2
     UNION ALL SELECT tenor, 'TOTAL', {_SUMS} FROM t GROUP BY 1""")
case("window_table_daily", "tenor period r_linked_bp:4 r_be_bp:4", lambda p: exports.window_table(p.tenors, "1999-03-01", "1999-04-10"),
     """WITH t AS (SELECT * FROM tenor_rets WHERE date BETWEEN DATE '1999-03-01' AND DATE '1999-04-10')
     SELECT tenor, strftime(date, '%Y-%m-%d') AS period, coalesce(sum(r_linked_bp), 0) AS r_linked_bp, coalesce(sum(r_be_bp), 0) AS r_be_bp FROM t GROUP BY 1, 2
     UNION ALL SELECT tenor, 'TOTAL', coalesce(sum(r_linked_bp), 0), coalesce(sum(r_be_bp), 0) FROM t GROUP BY 1""")
case("returns_export", "tenor date:d r_be_bp:4 long_be_bp:4 short_be_bp:4 cum_long_be_bp:3 cum_short_be_bp:3", lambda p: exports.returns_export(p.tenors, 3.0, 2.0),
     f"""SELECT *, CASE WHEN long_be_bp IS NOT NULL THEN sum(long_be_bp) OVER w END AS cum_long_be_bp, CASE WHEN short_be_bp IS NOT NULL THEN sum(short_be_bp) OVER w END AS cum_short_be_bp
     FROM ({_WT}) WINDOW w AS (PARTITION BY tenor ORDER BY date)""")
case("otr_levels", "leg tenor date:d bond_id ytm:4", lambda p: rolls.otr_levels(p.quotes, p.schedule),
     f"""WITH s AS (SELECT *, coalesce(lead(month) OVER (PARTITION BY leg, tenor ORDER BY month), CAST(month + INTERVAL 1 MONTH AS DATE)) AS until FROM {_SCHED})
     SELECT s.leg, s.tenor, q.date, q.bond_id, q.ytm FROM s JOIN fx_quotes q ON q.bond_id = s.bond_id AND q.date >= s.month AND q.date < s.until""")
_LEV = f"""(WITH s AS (SELECT *, coalesce(lead(month) OVER (PARTITION BY leg, tenor ORDER BY month), CAST(month + INTERVAL 1 MONTH AS DATE)) AS until FROM {_SCHED})
     SELECT s.leg, s.tenor, q.date, q.ytm FROM s JOIN fx_quotes q ON q.bond_id = s.bond_id AND q.date >= s.month AND q.date < s.until)"""
case("breakeven_yield", "tenor date:d real_ytm:4 nominal_ytm:4 breakeven:4", lambda p: rolls.breakeven_yield(rolls.otr_levels(p.quotes, p.schedule)),
     f"SELECT a.tenor, a.date, a.ytm AS real_ytm, b.ytm AS nominal_ytm, b.ytm - a.ytm AS breakeven FROM {_LEV} a JOIN {_LEV} b ON a.tenor = b.tenor AND a.date = b.date WHERE a.leg = 'linked' AND b.leg = 'nominal'")
case("level_coverage", "leg tenor days:i", lambda p: rolls.level_coverage(rolls.otr_levels(p.quotes, p.schedule)), f"SELECT leg, tenor, count(*) AS days FROM {_LEV} GROUP BY 1, 2")

# ------------------------------------------------------------------ invariants
case("check_tiling", "leg tenor rows:i days:i violations:i", lambda p: quality.check_tiling(p.legs),
     """SELECT leg, tenor, count(*) AS rows, sum(days) AS days, count(*) FILTER (g IS NOT NULL AND g <> days) AS violations
     FROM (SELECT *, settle - lag(settle) OVER (PARTITION BY leg, tenor ORDER BY date) AS g FROM leg_rets) GROUP BY 1, 2""")
case("check_roll_within_bond", "leg tenor rolls:i violations:i", lambda p: quality.check_roll_within_bond(p.legs, p.quotes, p.issue_days),
     """SELECT leg, tenor, count(*) AS rolls, count(*) FILTER (prior IS NULL OR prior < issue_date) AS violations FROM (
     SELECT r.*, i.issue_date, (SELECT max(date) FROM fx_quotes q WHERE q.bond_id = r.bond_id AND q.date < r.date) AS prior FROM leg_rets r LEFT JOIN iss_min i ON i.bond_id = r.bond_id WHERE is_roll) GROUP BY 1, 2""")
_HELD = """(SELECT tenor, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(bond_id, date) FILTER (leg = 'linked') AS linked_id, arg_max(bond_id, date) FILTER (leg = 'nominal') AS nominal_id
     FROM leg_rets GROUP BY 1, 2)"""
case("month_intersect", "tenor month:d linked_id nominal_id", lambda p: quality.month_intersect(p.legs), f"SELECT * FROM {_HELD} WHERE linked_id IS NOT NULL AND nominal_id IS NOT NULL")
_EXP = cv.values_clause([(t, m, *x) for t, tab in (("5y", cv.PAIRING_5Y), ("10y", cv.PAIRING_10Y), ("30y", cv.PAIRING_30Y)) for m, x in tab.items()])
case("check_pairing", "tenor months:i off_table:i failures:i", lambda p: quality.check_pairing(p.legs, rolls.maturity_first(p.auctions), cv.expected_pairing(p.spark)),
     f"""WITH h AS (SELECT h.*, month(a.maturity) AS lm, month(b.maturity) AS nm, max(h.month) OVER (PARTITION BY h.tenor) AS last FROM {_HELD} h JOIN fx_static a ON a.bond_id = linked_id JOIN fx_static b ON b.bond_id = nominal_id)
     SELECT h.tenor, count(*) AS months, count(*) FILTER (lm <> e.l OR nm <> e.n) AS off_table, count(*) FILTER ((lm <> e.l OR nm <> e.n) AND month > last - INTERVAL 60 MONTH) AS failures
     FROM h JOIN (VALUES {_EXP}) e(t, m, l, n) ON e.t = h.tenor AND e.m = month(h.month) GROUP BY 1""")

# ------------------------------------------------------------------ seasonality
case("monthly_anchor", "month:d auction:d new_issue", lambda p: seasonal.monthly_anchor(p.auctions, p.emit_from), "SELECT * FROM anchor_m")
case("month_anchors", "month:d a0:d a1:d a2:d a3:d a4:d clamped kind new_issue", lambda p: p.anchors, "SELECT * FROM anchors5")
case("seasonal_table", "tenor month:d period linked_pnl:4 nominal_pnl:4 linked_slip:6 nominal_slip:6 gas_pnl:2 trading_days:i clamped new_issue", lambda p: p.seasonal, "SELECT * FROM seas")
case("seasonal_qa", "months:i dom_min dom_max seam_breaks:i empty_p4:i empty_p1:i buckets:i", lambda p: seasonal.seasonal_qa(p.anchors, p.seasonal),
     """SELECT (SELECT count(*) FROM anchors5) AS months, (SELECT min(day(a2)) FROM anchors5) AS dom_min, (SELECT max(day(a2)) FROM anchors5) AS dom_max,
     (SELECT count(*) FROM anchors5 x JOIN anchors5 y ON y.month = x.month - INTERVAL 1 MONTH WHERE x.a0 <> y.a4) AS seam_breaks,
     count(*) FILTER (period = 4 AND trading_days = 0) AS empty_p4, count(*) FILTER (period = 1 AND trading_days = 0) AS empty_p1, count(*) AS buckets FROM seas""")
_SM = """SELECT s.*, (linked_pnl - 0.75 * nominal_pnl) - coalesce(h.b_linked_2y - 0.75 * h.b_nominal_2y, 0) * coalesce(gas_pnl, 0) / 1e5 - (2.0 * coalesce(linked_slip, 0) + 0.75 * 1.5 * coalesce(nominal_slip, 0)) AS value
     FROM seas s LEFT JOIN wf_legs h ON h.tenor = s.tenor AND h.month = s.month"""
case("seasonal_metric", "tenor month:d period value:4", lambda p: seasonal.seasonal_metric(p.seasonal, "be", 0.75, 2.0, 1.5, hedge=p.hedge_2y), _SM)
_be = lambda p: seasonal.seasonal_metric(p.seasonal)
case("seasonal_filters", "tenor month:d period value:4", lambda p: seasonal.seasonal_filters(_be(p), "3y", "reopen", [1, 2, 3, 4, 5, 6]),
     """SELECT * FROM (SELECT *, max(month) OVER (PARTITION BY tenor) AS last FROM seas_be) WHERE month >= last - INTERVAL 35 MONTH AND NOT new_issue AND month(month) <= 6""")
_Q3 = "quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3"
case("seasonal_agg", "tenor cal_month period median:4 q1:4 q3:4 n:i clamps:i cum_median:4", lambda p: seasonal.seasonal_agg(_be(p)),
     f"""SELECT *, sum(median) OVER (PARTITION BY tenor ORDER BY cal_month, period) AS cum_median FROM (
     SELECT tenor, month(month) AS cal_month, period, {_Q3}, count(value) AS n, count(*) FILTER (clamped) AS clamps FROM seas_be WHERE value IS NOT NULL GROUP BY 1, 2, 3)""")
case("seasonal_signature", "tenor period median:4 q1:4 q3:4 n:i", lambda p: seasonal.seasonal_signature(_be(p)), f"SELECT tenor, period, {_Q3}, count(value) AS n FROM seas_be WHERE value IS NOT NULL GROUP BY 1, 2")
case("seasonal_history", "tenor period x:d value:4 overall_median:4", lambda p: seasonal.seasonal_history(_be(p), (1, 3)),
     """SELECT tenor, period, CAST(month + to_days(CASE period WHEN 1 THEN 3 ELSE 17 END) AS DATE) AS x, value, quantile_cont(value, 0.5) OVER (PARTITION BY tenor) AS overall_median
     FROM seas_be WHERE value IS NOT NULL AND period IN (1, 3)""")
case("bdom", "tenor date:d bdom:i bdom_end:i", lambda p: seasonal.bdom(p.tenors),
     """SELECT tenor, date, rank() OVER (PARTITION BY tenor, date_trunc('month', date) ORDER BY date) AS bdom, -rank() OVER (PARTITION BY tenor, date_trunc('month', date) ORDER BY date DESC) AS bdom_end
     FROM tenor_rets WHERE days <> 0""")
for _end in (False, True):
    _k = "-rank() OVER (PARTITION BY tenor, date_trunc('month', date) ORDER BY date DESC)" if _end else "rank() OVER (PARTITION BY tenor, date_trunc('month', date) ORDER BY date)"
    case("calendar_effect" + ("_from_end" if _end else ""), "tenor day_key:i median:4 q1:4 q3:4 n:i mean:4 cum_median:3",
         lambda p, e=_end: seasonal.calendar_effect(seasonal.bdom(p.tenors), "r_be_bp", e),
         f"""SELECT *, sum(median) OVER (PARTITION BY tenor ORDER BY day_key) AS cum_median FROM (
         SELECT tenor, day_key, {_Q3.replace('value', 'r_be_bp')}, count(r_be_bp) AS n, avg(r_be_bp) AS mean FROM (SELECT *, {_k} AS day_key FROM tenor_rets WHERE days <> 0) WHERE r_be_bp IS NOT NULL GROUP BY 1, 2)""")
case("period_regressions", "tenor pair n:i slope:4 intercept:4 r2:5 tstat:4",
     lambda p: seasonal.period_regressions(seasonal.seasonal_filters(_be(p), issue="reopen"), _be(p)),
     f"""WITH f AS (SELECT tenor, month, max(value) FILTER (period = 1) AS p1, max(value) FILTER (period = 2) AS p2, max(value) FILTER (period = 3) AS p3, max(value) FILTER (period = 4) AS p4
       FROM seas_be WHERE value IS NOT NULL AND NOT new_issue GROUP BY 1, 2),
     t AS (SELECT tenor, month, value FROM seas_be WHERE period = 1),
     w AS (SELECT f.*, t.value AS np1, coalesce(p1, 0) + coalesce(p2, 0) + coalesce(p3, 0) + coalesce(p4, 0) AS tot FROM f LEFT JOIN t ON t.tenor = f.tenor AND t.month = f.month + INTERVAL 1 MONTH),
     v AS (SELECT *, lead(tot) OVER (PARTITION BY tenor ORDER BY month) AS ntot FROM w),
     l AS (SELECT tenor, 'P1>P2' AS pair, p1 AS x, p2 AS y FROM v UNION ALL SELECT tenor, 'P2>P3', p2, p3 FROM v UNION ALL SELECT tenor, 'P3>P4', p3, p4 FROM v UNION ALL SELECT tenor, 'P23>P4', p2 + p3, p4 FROM v
       UNION ALL SELECT tenor, 'P12>P3', p1 + p2, p3 FROM v UNION ALL SELECT tenor, 'P12>P34', p1 + p2, p3 + p4 FROM v UNION ALL SELECT tenor, 'P4>P1n', p4, np1 FROM v UNION ALL SELECT tenor, 'M>Mn', tot, ntot FROM v)
     SELECT tenor, pair, {ols('x', 'y')} FROM l GROUP BY 1, 2""")
_SL = "(SELECT tenor, month, sum(value) AS slice FROM seas_be WHERE value IS NOT NULL AND period IN (2, 3) GROUP BY 1, 2)"
case("slice_cumulative", "tenor month:d slice:4 cum:3", lambda p: seasonal.slice_cumulative(_be(p), (2, 3)), f"SELECT *, sum(slice) OVER (PARTITION BY tenor ORDER BY month) AS cum FROM {_SL}")
case("perf_metrics_slice", "tenor n:i total:3 mean:4 vol:4 sharpe:4 max_drawdown:3", lambda p: stats.perf_metrics_slice(seasonal.slice_cumulative(_be(p), (2, 3)), ["tenor"], "month", "slice"),
     f"""WITH c AS (SELECT *, sum(slice) OVER (PARTITION BY tenor ORDER BY month) AS cum FROM {_SL}),
     d AS (SELECT *, max(cum) OVER (PARTITION BY tenor ORDER BY month) - cum AS dd FROM c),
     a AS (SELECT tenor, count(*) AS n, sum(slice) AS total, avg(slice) AS mean, coalesce(stddev_samp(slice), 0) AS vol, max(dd) AS max_drawdown, date_diff('month', min(month), max(month)) / 12.0 AS yrs FROM d GROUP BY 1)
     SELECT *, CASE WHEN vol > 0 THEN mean / vol * sqrt(n / yrs) ELSE 0.0 END AS sharpe FROM a""")
case("drawdown", "tenor date:d drawdown:3", lambda p: ordered.drawdown(p.tenors.where("cum_be_bp IS NOT NULL"), ["tenor"], "date", "cum_be_bp"),
     "SELECT tenor, date, max(cum_be_bp) OVER (PARTITION BY tenor ORDER BY date) - cum_be_bp AS drawdown FROM tenor_rets WHERE cum_be_bp IS NOT NULL")
_ES = """(WITH n AS (SELECT tenor, date, r_be_bp AS v, row_number() OVER (PARTITION BY tenor ORDER BY date) AS pos FROM tenor_rets),
     a AS (SELECT n.tenor, a.month, a.new_issue, n.pos AS at FROM n JOIN anchors5 a ON a.a2 = n.date),
     o AS (SELECT a.*, CAST(k AS INTEGER) AS off, n.v FROM a CROSS JOIN range(-10, 11) r(k) LEFT JOIN n ON n.tenor = a.tenor AND n.pos = a.at + k AND n.pos > 1),
     c AS (SELECT *, CASE WHEN v IS NOT NULL THEN sum(v) OVER (PARTITION BY tenor, month ORDER BY off) END AS cum FROM o)
     SELECT tenor, month, new_issue, off AS "offset", cum - base AS path FROM (SELECT *, max(cum) FILTER (off = 0) OVER (PARTITION BY tenor, month) AS base FROM c) WHERE base IS NOT NULL)"""
case("event_study_us", "tenor month:d offset path:4", lambda p: seasonal.event_study(p.tenors, "r_be_bp", p.anchors, 10), f"SELECT * FROM {_ES}")
case("event_summary_us", "tenor offset median:4 mean:4 n:i", lambda p: seasonal.event_summary(seasonal.event_study(p.tenors, "r_be_bp", p.anchors, 10)),
     f"""SELECT tenor, "offset", quantile_cont(path, 0.5) AS median, avg(path) AS mean, count(path) AS n FROM {_ES} GROUP BY 1, 2""")
case("robust_range", "tenor n:i lo:4 hi:4", lambda p: stats.robust_range(p.tenors, ["tenor"], "r_be_bp"),
     """SELECT tenor, n, a - CASE WHEN (b - a) * 0.1 = 0 THEN 1 ELSE (b - a) * 0.1 END AS lo, b + CASE WHEN (b - a) * 0.1 = 0 THEN 1 ELSE (b - a) * 0.1 END AS hi
     FROM (SELECT tenor, count(r_be_bp) AS n, quantile_cont(r_be_bp, 0.01) AS a, quantile_cont(r_be_bp, 0.99) AS b FROM tenor_rets GROUP BY 1)""")
