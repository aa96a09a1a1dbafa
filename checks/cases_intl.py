"""Issuance, constant-maturity buckets, event studies, marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from realcurve.functions import ordered, stats
from realcurve.operators import cmt, exports, hedge, issuance, pairs, studies
from realcurve.sources import cleaning, landed

from .ctes import LONG, label_sql, ols
from .registry import case

# ------------------------------------------------------------------ issuance
case("bond_issuance", "market country bond_id issue_date:d issue_year maturity:d orig_tenor amt_issued_bn:2 amt_out_bn:2", lambda p: p.issuance, "SELECT * FROM iss_lines")
case("reopening_events", "market bond_id event_date:d amt_bn:2 orig_tenor remaining_tenor", lambda p: issuance.reopening_events(p.issuance, p.taps), "SELECT * FROM iss_reop")
case("events_log", "market bond_id event_date:d event_year type amt_bn:2 remaining_tenor source", lambda p: p.events, "SELECT * FROM iss_events")
case("issue_events_static", "bond_id market country event_date:d event_type amount:0 reopening source", lambda p: issuance.issue_events_static(p.bonds),
     "SELECT bond_id, market, country, issue AS event_date, 'issue' AS event_type, amt_issued AS amount, false AS reopening, 'static' AS source FROM fx_static WHERE linked")
_STEPS = """(SELECT bond_id, date AS event_date, amount - lag(amount) OVER (PARTITION BY bond_id ORDER BY date) AS step FROM (
     SELECT bond_id, date, amt_issued + CASE WHEN bond_id % 10 = 0 THEN 0 ELSE CAST(sum(cents) OVER (PARTITION BY bond_id ORDER BY date) AS DOUBLE) * 10.0 END AS amount FROM (
     SELECT bond_id, any_value(amt_issued) AS amt_issued, event_date AS date, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM fx_taps GROUP BY bond_id, event_date)))"""
case("step_ups", "bond_id event_date:d amount:0", lambda p: issuance.step_ups(p.outstanding), f"SELECT bond_id, event_date, step AS amount FROM {_STEPS} WHERE step > 5e7")
case("union_events", "bond_id event_date:d event_type amount:0 reopening source settle_date:d", lambda p: issuance.union_events(
         issuance.issue_events_static(p.bonds), issuance.step_ups(p.outstanding)),
     f"""SELECT bond_id, issue AS event_date, 'issue' AS event_type, amt_issued AS amount, false AS reopening, 'static' AS source, dated AS settle_date FROM fx_static WHERE linked
     UNION ALL SELECT bond_id, event_date, 'reopening', step, true, 'step', NULL FROM {_STEPS} WHERE step > 5e7""")
_T = (5, 10, 30)
case("issuance_pivot", "market event_year t5y:i t10y:i t30y:i", lambda p: issuance.issuance_pivot(p.events, "reopening", _T),
     "SELECT market, event_year, " + ", ".join(f"count(*) FILTER (orig_tenor = {t}) AS t{t}y" for t in _T) + " FROM iss_events WHERE type = 'reopening' GROUP BY 1, 2")
case("issuance_pivot_amount", "market event_year t5y:1 t10y:1 t30y:1", lambda p: issuance.issuance_pivot(p.events, "new", _T, "amount"),
     "SELECT market, event_year, " + ", ".join(f"coalesce(floor((sum(CAST(round(amt_bn * 100) AS BIGINT)) FILTER (orig_tenor = {t}) + 5) / 10) / 10.0, 0) AS t{t}y" for t in _T) + " FROM iss_events WHERE type = 'new' GROUP BY 1, 2")
case("issuance_pivot_combined", "market event_year t5y t10y t30y", lambda p: issuance.issuance_pivot_combined(p.events, _T),
     "WITH c AS (SELECT market, event_year, " + ", ".join(f"count(*) FILTER (orig_tenor = {t} AND type = 'new') AS n{t}, count(*) FILTER (orig_tenor = {t} AND type = 'reopening') AS r{t}" for t in _T)
     + " FROM iss_events GROUP BY 1, 2) SELECT market, event_year, "
     + ", ".join(f"CASE WHEN n{t} > 0 AND r{t} > 0 THEN n{t} || '+' || r{t} || 'x' WHEN r{t} > 0 THEN r{t} || 'x' WHEN n{t} > 0 THEN CAST(n{t} AS VARCHAR) ELSE '' END AS t{t}y" for t in _T) + " FROM c")
_BN = lambda kind: f"coalesce(floor((sum(CAST(round(amt_bn * 100) AS BIGINT)) FILTER (type = '{kind}') + 5) / 10) / 10.0, 0)"
case("issuance_cells", "market event_year orig_tenor n_new:i n_reopening:i new_bn:1 reopening_bn:1 cell", lambda p: issuance.issuance_cells(p.events),
     f"""SELECT *, CASE WHEN n_new > 0 AND n_reopening > 0 THEN n_new || '+' || n_reopening || 'x' WHEN n_reopening > 0 THEN n_reopening || 'x' WHEN n_new > 0 THEN CAST(n_new AS VARCHAR) ELSE '' END AS cell FROM (
     SELECT market, event_year, orig_tenor, count(*) FILTER (type = 'new') AS n_new, count(*) FILTER (type = 'reopening') AS n_reopening, {_BN('new')} AS new_bn, {_BN('reopening')} AS reopening_bn FROM iss_events GROUP BY 1, 2, 3)""")
case("issuance_long", "market event_year orig_tenor type n:i amt_bn:1", lambda p: issuance.issuance_long(p.events),
     "SELECT market, event_year, orig_tenor, type, count(*) AS n, floor((sum(CAST(round(amt_bn * 100) AS BIGINT)) + 5) / 10) / 10.0 AS amt_bn FROM iss_events GROUP BY 1, 2, 3, 4")
case("issuance_summary", "market bonds:i reopenings:i first_year last_year min_tenor max_tenor amt_out_bn:0", lambda p: issuance.issuance_summary(p.issuance, p.events),
     """SELECT l.market, count(*) AS bonds, coalesce((SELECT count(*) FROM iss_reop r WHERE r.market = l.market), 0) AS reopenings, min(issue_year) AS first_year, max(issue_year) AS last_year,
     min(orig_tenor) AS min_tenor, max(orig_tenor) AS max_tenor, round(sum(amt_out_bn), 0) AS amt_out_bn FROM iss_lines l GROUP BY 1""")
case("same_bond_multi_tap", "market bond_id month:d n:i types amt_bn:2 dates", lambda p: issuance.same_bond_multi_tap(p.events),
     """SELECT market, bond_id, CAST(date_trunc('month', event_date) AS DATE) AS month, count(*) AS n, array_to_string(list_sort(list(DISTINCT type)), ';') AS types, sum(amt_bn) AS amt_bn,
     array_to_string(list_sort(list(DISTINCT CAST(event_date AS VARCHAR))), ';') AS dates FROM iss_events GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
_MM = "(SELECT market, CAST(date_trunc('month', event_date) AS DATE) AS month, count(*) AS events, count(DISTINCT bond_id) AS bonds, sum(amt_bn) AS amt_bn FROM iss_events GROUP BY 1, 2)"
case("busy_months", "market month:d events:i bonds:i amt_bn:2", lambda p: issuance.busy_months(p.events), f"SELECT * FROM {_MM} WHERE bonds >= 2")
case("busy_month_members", "market month:d bond_id", lambda p: issuance.busy_month_members(p.events),
     f"SELECT DISTINCT e.market, m.month, e.bond_id FROM iss_events e JOIN {_MM} m ON m.market = e.market AND m.month = date_trunc('month', e.event_date) WHERE m.bonds >= 2")
case("auction_density", "market auction_months:i max_bonds_mo:i months_2plus_bonds:i pct_months_2plus", lambda p: issuance.auction_density(p.events),
     f"""SELECT market, count(*) AS auction_months, max(bonds) AS max_bonds_mo, count(*) FILTER (bonds >= 2) AS months_2plus_bonds, CAST(round_even(100.0 * count(*) FILTER (bonds >= 2) / count(*), 0) AS INTEGER) AS pct_months_2plus
     FROM {_MM} GROUP BY 1""")
case("auctions_by_bucket", "market bond_id event_date:d bucket amt_bn:2", lambda p: p.tagged, "SELECT * FROM iss_bucket")
_FY, _LY = 1995, 2002
case("bucket_coverage", "market bucket auctions_all:i auctions_recent:i bonds:i presence_pct:i", lambda p: issuance.bucket_coverage(p.events, _FY, _LY, "1999-01-01"),
     f"""WITH g AS (SELECT last_day(CAST(unnest(generate_series(DATE '{_FY}-01-01', DATE '{_LY}-12-01', INTERVAL 1 MONTH)) AS DATE)) AS mid),
     a AS (SELECT DISTINCT market, {label_sql('((maturity - mid) / 365.25)', LONG)} AS bucket, mid FROM first_ev, g WHERE issued <= mid AND mid <= maturity),
     p AS (SELECT market, bucket, count(*) AS c FROM a WHERE bucket IS NOT NULL GROUP BY 1, 2),
     s AS (SELECT market, bucket, count(*) AS n, count(*) FILTER (event_date >= DATE '1999-01-01') AS r, count(DISTINCT bond_id) AS b FROM iss_bucket GROUP BY 1, 2)
     SELECT coalesce(p.market, s.market) AS market, coalesce(p.bucket, s.bucket) AS bucket, coalesce(n, 0) AS auctions_all, coalesce(r, 0) AS auctions_recent, coalesce(b, 0) AS bonds,
     coalesce(round_even(100.0 * c / {(_LY - _FY + 1) * 12}, 0), 0) AS presence_pct FROM p FULL JOIN s ON p.market = s.market AND p.bucket = s.bucket""")
_YRS = (1997, 1999, 2001)
_TG = "CASE bucket WHEN '2y' THEN 2.5 WHEN '5y' THEN 4.5 WHEN '7y' THEN 7 WHEN '10y' THEN 10 WHEN '12y' THEN 12.5 WHEN '15y' THEN 15.5 WHEN '20y' THEN 20 WHEN '25y' THEN 25 WHEN '30y' THEN 31 WHEN '40y' THEN 40 ELSE 50 END"
case("bucket_occupancy", "market bucket " + " ".join(f"y{y}" for y in _YRS), lambda p: issuance.bucket_occupancy(p.events, _YRS),
     f"""WITH a AS (SELECT f.*, y.mid, (maturity - y.mid) / 365.25 AS rem FROM first_ev f, (VALUES {', '.join(f"(DATE '{y}-06-30')" for y in _YRS)}) y(mid) WHERE issued <= y.mid AND y.mid <= maturity),
     b AS (SELECT *, {label_sql('rem', LONG)} AS bucket FROM a),
     c AS (SELECT market, bucket, year(mid) AS yr, arg_min(maturity, (abs(rem - {_TG}), year(maturity), bond_id)) AS m, count(*) AS n FROM b WHERE bucket IS NOT NULL GROUP BY 1, 2, 3),
     d AS (SELECT market, bucket, yr, right(CAST(year(m) AS VARCHAR), 2) || CASE WHEN n > 1 THEN '*' ELSE '' END AS cell FROM c)
     SELECT market, bucket, {', '.join(f"coalesce(max(cell) FILTER (yr = {y}), '·') AS y{y}" for y in _YRS)} FROM d GROUP BY 1, 2""")
# every year from the first to the last event, as rows
case("bucket_occupancy_years", "market bucket year:i cell", lambda p: issuance.bucket_occupancy_years(p.events),
     f"""WITH y AS (SELECT make_date(unnest(generate_series(min(year(event_date)), max(year(event_date)))), 6, 30) AS mid FROM iss_events),
     b AS (SELECT f.*, mid, (maturity - mid) / 365.25 AS rem, {label_sql('((maturity - mid) / 365.25)', LONG)} AS bucket FROM first_ev f JOIN y ON issued <= mid AND mid <= maturity)
     SELECT market, bucket, year(mid) AS year, right(CAST(year(arg_min(maturity, (abs(rem - {_TG}), year(maturity), bond_id))) AS VARCHAR), 2) || CASE WHEN count(*) > 1 THEN '*' ELSE '' END AS cell
     FROM b WHERE bucket IS NOT NULL GROUP BY 1, 2, 3""")

# ------------------------------------------------------------------ constant maturity
case("held_monthly", "market bucket month:d bond_id", lambda p: p.held, "SELECT * FROM held_m")
case("nominal_pool", "bond_id country maturity:d issue:d", lambda p: p.pool, "SELECT * FROM nom_pool")
case("closest_nominal", "market bucket month:d bond_id nominal_id nominal_maturity:d", lambda p: p.matched, "SELECT * FROM held_n")
case("needed_nominals", "bond_id", lambda p: cmt.needed_nominals(p.matched), "SELECT DISTINCT nominal_id AS bond_id FROM held_n WHERE nominal_id IS NOT NULL")
case("date_union_grid", "market date:d", lambda p: cmt.date_union_grid(p.returns_of(cmt.needed_bonds(p.matched)), p.matched), "SELECT DISTINCT market, date FROM (SELECT h.market, r.date FROM bond_rets r JOIN (SELECT DISTINCT market, bond_id FROM held_n) h ON h.bond_id = r.bond_id)")
case("map_lookup", "market bucket month:d bond_id coupon:4 issue:d", lambda p: p.held.join(p.bonds.select("bond_id", "coupon", "issue"), "bond_id", "left"),
     "SELECT h.*, b.coupon, b.issue FROM held_m h LEFT JOIN fx_static b USING (bond_id)")
case("bucket_series", "market bucket date:d bond_id nominal_id r_linked_bp:4 r_nominal_bp:4 nominal_mat_gap_y:4 is_roll_day held_roll_from is_auction_date auction_bonds:i auction_amount:2 auction_is_held",
     lambda p: p.buckets, "SELECT * FROM bk_series")
case("cum_flat_gap", "market bucket date:d cum_linked_bp:3 cum_nominal_bp:3 cum_be_bp:3", lambda p: p.buckets, "SELECT * FROM bk_series")
case("bucket_taps", "market bucket date:d bond_id amt_bn:2", lambda p: cmt.bucket_taps(p.tagged), "SELECT market, bucket, event_date AS date, bond_id, sum(amt_bn) AS amt_bn FROM iss_bucket GROUP BY 1, 2, 3, 4")
case("bucket_summary", "market bucket names:i rolls:i auctions:i days_held:i first:d last:d cum_linked_bp:3 be_first:d be_cov_pct cum_be_bp:3", lambda p: cmt.bucket_summary(p.buckets),
     """SELECT market, bucket, count(DISTINCT bond_id) AS names, count(*) FILTER (is_roll_day) AS rolls, count(*) FILTER (is_auction_date) AS auctions, count(bond_id) AS days_held,
     min(date) FILTER (bond_id IS NOT NULL) AS first, max(date) FILTER (bond_id IS NOT NULL) AS last, arg_max(cum_linked_bp, date) AS cum_linked_bp, min(date) FILTER (r_be_bp IS NOT NULL) AS be_first,
     CAST(round_even(100.0 * count(r_be_bp) / count(bond_id), 0) AS INTEGER) AS be_cov_pct, arg_max(cum_be_bp, date) AS cum_be_bp FROM bk_series GROUP BY 1, 2""")
_SEG = """(WITH s AS (SELECT *, CASE WHEN lag(bond_id) OVER w IS DISTINCT FROM bond_id OR lag(nominal_id) OVER w IS DISTINCT FROM nominal_id THEN 1 ELSE 0 END AS t
     FROM bk_series WHERE bond_id IS NOT NULL AND nominal_id IS NOT NULL WINDOW w AS (PARTITION BY market, bucket ORDER BY date))
     SELECT *, sum(t) OVER (PARTITION BY market, bucket ORDER BY date) AS segment FROM s)"""
case("session_segments", "market bucket date:d segment:i", lambda p: ordered.session_segments(
    p.buckets.where("bond_id IS NOT NULL AND nominal_id IS NOT NULL"), ["market", "bucket"], "date", ["bond_id", "nominal_id"]), f"SELECT * FROM {_SEG}")
_MIS = f"(SELECT market, bucket, segment, bond_id, nominal_id, round(arg_min(nominal_mat_gap_y, date), 2) AS gap_y, min(date) AS used_from, max(date) AS used_to, count(*) AS days FROM {_SEG} GROUP BY 1, 2, 3, 4, 5)"
case("hedge_mismatch", "market bucket segment:i bond_id nominal_id gap_y:2 used_from:d used_to:d days:i", lambda p: cmt.hedge_mismatch(p.buckets), f"SELECT * FROM {_MIS}")
case("worst_mismatch", "market bucket segment:i bond_id gap_y:2 days:i", lambda p: cmt.worst_mismatch(cmt.hedge_mismatch(p.buckets)), f"SELECT * FROM {_MIS} ORDER BY abs(gap_y) DESC, market, bucket, segment LIMIT 20")

# ------------------------------------------------------------------ event studies and calendar statistics
_PATH = """(WITH d AS (
       SELECT market, bucket, date, r_linked_bp, r_be_bp, is_auction_date, row_number() OVER w AS pos, count(*) FILTER (is_auction_date) OVER (PARTITION BY market, bucket) AS taps,
         count(r_be_bp) OVER (PARTITION BY market, bucket) AS be_days, count(r_linked_bp) OVER (PARTITION BY market, bucket) AS out_days
       FROM bk_series WHERE market <> 'DE_EI' WINDOW w AS (PARTITION BY market, bucket ORDER BY date)),
     k AS (SELECT d.*, c.cc FROM d ASOF LEFT JOIN (SELECT date, sum(usd_per_contract) OVER (ORDER BY date) AS cc FROM crude_spl) c ON d.date >= c.date WHERE taps >= 3 AND out_days > 0),
     o AS (SELECT t.market, t.bucket, t.date AS tap_date, CAST(r.k AS INTEGER) AS off, x.date AS seen, x.r_linked_bp AS rl, x.r_be_bp AS rb, x.cc, t.be_days
       FROM k t CROSS JOIN range(-21, 22) r(k) LEFT JOIN k x ON x.market = t.market AND x.bucket = t.bucket AND x.pos = t.pos + r.k WHERE t.is_auction_date),
     c AS (SELECT *, sum(coalesce(rl, 0)) OVER v AS co, sum(coalesce(rb, 0)) OVER v AS cb FROM o WINDOW v AS (PARTITION BY market, bucket, tap_date ORDER BY off)),
     z AS (SELECT *, max(co) FILTER (off = 0) OVER u AS co0, max(cb) FILTER (off = 0) OVER u AS cb0, max(cc) FILTER (off = 0) OVER u AS cc0 FROM c WINDOW u AS (PARTITION BY market, bucket, tap_date))
     SELECT market, bucket, tap_date, off AS "offset", CASE WHEN seen IS NOT NULL THEN co - co0 END AS out_path, CASE WHEN seen IS NOT NULL AND be_days > 0 THEN cb - cb0 END AS be_path,
       CASE WHEN seen IS NOT NULL THEN cc - cc0 END AS crude_path FROM z)"""
_paths = lambda p: studies.event_study_bucket(p.buckets, crude=p.crude)
case("event_study_bucket", "market bucket tap_date:d offset out_path:3 be_path:3 energy_bp:4", lambda p: _paths(p).withColumn("energy_bp", F.col("crude_path") * 39.1140 / 1e5), f"SELECT *, crude_path * 39.1140 / 1e5 AS energy_bp FROM {_PATH}")
_QS = "count({v}) AS n, avg({v}) AS mean, quantile_cont({v}, 0.5) AS median, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3, quantile_cont({v}, 0.1) AS p10, quantile_cont({v}, 0.9) AS p90, min({v}) AS lo, max({v}) AS hi"
_QSPEC = "n:i mean:3 median:3 q1:3 q3:3 p10:3 p90:3 lo:3 hi:3"
case("cycle_distribution", "market bucket offset " + _QSPEC, lambda p: studies.cycle_distribution(studies.cycle_values(_paths(p), "out")),
     f"""SELECT market, bucket, "offset", {_QS.format(v='out_path')} FROM {_PATH} WHERE out_path IS NOT NULL GROUP BY 1, 2, 3""")
case("cycle_distribution_beta", "market bucket offset " + _QSPEC, lambda p: studies.cycle_distribution(studies.cycle_values(_paths(p), "be", 0.75, since="1998-12-01")),
     f"""SELECT market, bucket, "offset", {_QS.format(v='v')} FROM (SELECT *, out_path - 0.75 * (out_path - be_path) AS v FROM {_PATH} WHERE tap_date >= DATE '1998-12-01') WHERE v IS NOT NULL GROUP BY 1, 2, 3""")
case("quantile_stats", "bond_id " + _QSPEC, lambda p: stats.quantile_stats(p.bond_returns.select("bond_id", "bp"), ["bond_id"], "bp"), f"SELECT bond_id, {_QS.format(v='bp')} FROM bond_rets GROUP BY 1")
case("cycle_period_regressions", "market bucket pair n:i slope:4 intercept:3 r2:5 tstat:3", lambda p: studies.cycle_period_regressions(studies.cycle_values(_paths(p), "out")),
     f"""WITH w AS (SELECT market, bucket, tap_date, {', '.join(f'max(out_path) FILTER ("offset" = {k}) AS v{i}' for i, k in enumerate((-10, -5, 0, 5, 10)))} FROM {_PATH} GROUP BY 1, 2, 3),
     k AS (SELECT * FROM w WHERE v0 IS NOT NULL AND v1 IS NOT NULL AND v2 IS NOT NULL AND v3 IS NOT NULL AND v4 IS NOT NULL),
     l AS (SELECT market, bucket, 'P1>P2' AS pair, v1 - v0 AS x, v2 - v1 AS y FROM k UNION ALL SELECT market, bucket, 'P2>P3', v2 - v1, v3 - v2 FROM k UNION ALL SELECT market, bucket, 'P3>P4', v3 - v2, v4 - v3 FROM k)
     SELECT market, bucket, pair, {ols('x', 'y')} FROM l GROUP BY 1, 2, 3""")
_MS = """(WITH s AS (SELECT market, bucket, CAST(date_trunc('month', date) AS DATE) AS month, CASE WHEN count(r_linked_bp) >= 10 THEN sum(r_linked_bp) END AS r_linked_bp, CASE WHEN count(r_be_bp) >= 10 THEN sum(r_be_bp) END AS r_be_bp
       FROM bk_series GROUP BY 1, 2, 3),
     g AS (SELECT market, bucket, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM s GROUP BY 1, 2)
     SELECT g.*, s.r_linked_bp, s.r_be_bp FROM g LEFT JOIN s USING (market, bucket, month))"""
case("monthly_sum_min10", "market bucket month:d r_linked_bp:3 r_be_bp:3", lambda p: studies.monthly_sum_min10(p.buckets), f"SELECT * FROM {_MS}")
case("calendar_month", "market bucket cal_month years:i " + _QSPEC, lambda p: studies.calendar_month(studies.monthly_sum_min10(p.buckets), "out"),
     f"""SELECT *, (SELECT count(DISTINCT year(month)) FROM {_MS} y WHERE y.market = a.market AND y.bucket = a.bucket AND y.r_linked_bp IS NOT NULL) AS years FROM (
     SELECT market, bucket, month(month) AS cal_month, {_QS.format(v='r_linked_bp')} FROM {_MS} WHERE r_linked_bp IS NOT NULL GROUP BY 1, 2, 3) a""")
case("reindex_dense", "market bucket month:d r_linked_bp:3", lambda p: studies.monthly_sum_min10(p.buckets).fillna({"r_linked_bp": 0.0}), f"SELECT market, bucket, month, coalesce(r_linked_bp, 0) AS r_linked_bp FROM {_MS}")
_WK = """(SELECT market, bucket, CAST(date + to_days(CAST((12 - isodow(date)) % 7 AS INTEGER)) AS DATE) AS week, arg_max(cum_linked_bp, date) AS cum_linked_bp, arg_max(cum_be_bp, date) AS cum_be_bp FROM bk_series GROUP BY 1, 2, 3)"""
_wk = lambda p: ordered.weekly_sample(p.buckets, ["market", "bucket"], "date", ["cum_linked_bp", "cum_be_bp"])
case("weekly_sample", "market bucket week:d cum_linked_bp:3 cum_be_bp:3", _wk, f"SELECT * FROM {_WK}")
case("perf_metrics_weekly", "market bucket points:i ann_ret:3 ann_vol:3 sharpe:4 max_dd:3 hit_pct:3", lambda p: stats.perf_metrics_weekly(_wk(p), ["market", "bucket"], "week", "cum_linked_bp"),
     f"""WITH m AS (SELECT *, cum_linked_bp - lag(cum_linked_bp) OVER w AS mv, cum_linked_bp - max(cum_linked_bp) OVER w AS u FROM {_WK} WINDOW w AS (PARTITION BY market, bucket ORDER BY week))
     SELECT market, bucket, count(*) AS points, avg(mv) * 52 AS ann_ret, stddev_samp(mv) * sqrt(52) AS ann_vol, CASE WHEN stddev_samp(mv) > 0 THEN avg(mv) * 52 / (stddev_samp(mv) * sqrt(52)) END AS sharpe, min(u) AS max_dd,
     count(*) FILTER (mv > 1e-9)::DOUBLE / count(mv) * 100 AS hit_pct FROM m GROUP BY 1, 2 HAVING count(*) >= 4""")
case("rebase_to_start", "market bucket week:d rebased:3", lambda p: ordered.rebase_to_start(_wk(p), ["market", "bucket"], "week", "cum_linked_bp", "1998-01-01", "2000-12-31", short=True),
     f"SELECT market, bucket, week, -(cum_linked_bp - first_value(cum_linked_bp) OVER (PARTITION BY market, bucket ORDER BY week)) AS rebased FROM {_WK} WHERE week BETWEEN DATE '1998-01-01' AND DATE '2000-12-31'")
case("slip_cumulative", "market bucket week:d slip:4", lambda p: exports.slip_cumulative(p.buckets, ["market", "bucket"], "linked_fin_bp"),
     """SELECT market, bucket, CAST(date + to_days(CAST((12 - isodow(date)) % 7 AS INTEGER)) AS DATE) AS week, arg_max(s, date) AS slip FROM (
     SELECT market, bucket, date, sum(linked_fin_bp / gc) OVER (PARTITION BY market, bucket ORDER BY date) AS s FROM bk_series WHERE gc > 0 AND linked_fin_bp IS NOT NULL) GROUP BY 1, 2, 3""")

case("tail_rows", "market bucket month:d r_linked_bp:3", lambda p: ordered.tail_rows(studies.monthly_sum_min10(p.buckets), ["market", "bucket"], "month", 12),
     f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, bucket ORDER BY month DESC) AS k FROM {_MS}) WHERE k <= 12")
case("distinct_first", "bond_id event_date:d type amt_bn:2", lambda p: ordered.first_in_order(p.events.select("bond_id", "event_date", "type", "amt_bn"), ["bond_id"], [F.col("event_date"), F.col("type")]),
     "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bond_id ORDER BY event_date, type) AS k FROM iss_events) WHERE k = 1")

# ------------------------------------------------------------------ exports and marts
case("bond_sheet", "bond_id date:d country program settlement_date:d clean:4 gc_repo:9 bp:4", lambda p: exports.bond_sheet(p.bond_returns.drop("country"), p.bonds, p.conv),
     "SELECT r.bond_id, r.date, c.country, c.program, r.settle AS settlement_date, r.clean, r.gc AS gc_repo, r.bp FROM bond_rets r JOIN fx_static b ON b.bond_id = r.bond_id JOIN fx_conv c ON c.conv_id = b.conv_id")
case("isin_directory", "bond_id role country coupon:4 maturity:d comparator_id", lambda p: exports.isin_directory(p.bonds, p.pair_map),
     """SELECT bond_id, 'linker' AS role, country, coupon, maturity, bond_id + 1 AS comparator_id FROM fx_static WHERE linked
     UNION ALL SELECT l.bond_id + 1, 'nominal', n.country, n.coupon, n.maturity, NULL FROM fx_static l LEFT JOIN fx_static n ON n.bond_id = l.bond_id + 1 WHERE l.linked""")
case("mart_cmt", "market bucket date:d held_id nominal_id r_linked_bp:4 cum_linked_bp:3 auction_bonds:i", lambda p: cmt.mart_cmt(p.buckets), "SELECT *, bond_id AS held_id FROM bk_series")
case("mart_auctions", "market bond_id event_date:d type amt_bn:2 remaining_tenor_y:2 bucket source", lambda p: issuance.mart_auctions(p.events),
     f"SELECT *, {label_sql('remaining_tenor_y', LONG)} AS bucket FROM (SELECT *, round((maturity - event_date) / 365.25, 2) AS remaining_tenor_y FROM iss_events)")
case("mart_bonds", "bond_id market country program maturity:d first_issue:d coupon:4", lambda p: exports.mart_bonds(p.bonds, p.conv),
     "SELECT bond_id, market, b.country, program, maturity, issue AS first_issue, coupon FROM fx_static b JOIN fx_conv c ON c.conv_id = b.market WHERE linked")
case("write_mart", "format market bucket date:d held_id nominal_id nominal_mat_gap_y:4 r_linked_bp:4 r_be_bp:4 cum_linked_bp:3 is_roll_day is_auction_date auction_bonds:i auction_amount:2 auction_is_held", lambda p: cleaning.round_trip_mart(p.spark, cmt.mart_cmt(p.buckets)),
     "SELECT format, *, bond_id AS held_id FROM bk_series, (VALUES ('parquet'), ('csv')) f(format)")
case("read_pair_map", "real_id nominal_id beta:2 note", lambda p: pairs.scan_pair_map(cleaning.pair_map_round_trip(p.spark, p.pair_map)),
     "SELECT CAST(bond_id AS VARCHAR) AS real_id, CAST(bond_id + 1 AS VARCHAR) AS nominal_id, 1.0 AS beta, CASE WHEN bond_id % 3 < 2 THEN 'L' || bond_id || ' vs N' || (bond_id + 1) END AS note FROM fx_static WHERE linked")
_PAGE = "out:i be:i slip_l:i slip_n:i crude:i crude_b:3"


def _market_page(p):
    """The documents of all markets, taken apart again."""
    ratios = hedge.full_sample_betas(p.pairs_buckets, ["market", "bucket"], 30).select("market", "bucket", F.col("be_beta").alias("crude_b"))
    docs = exports.market_payload(exports.market_series(p.buckets, p.linked_returns, p.pair_levels, p.crude, ratios))
    arrays = ["out", "be", "slip_l", "slip_n", "crude"]
    read = docs.select("market", "kind", "key", F.from_json("payload", "x array<string>, " + ", ".join(f"{c} array<long>" for c in arrays) + ", crude_b double").alias("d"))
    at = lambda c: F.get(f"d.{c}", F.col("i")).alias(c)
    return read.select("market", "kind", "key", "d", F.posexplode("d.x").alias("i", "week")).select("market", "kind", "key", "week", *[at(c) for c in arrays], F.col("d.crude_b").alias("crude_b"))


_FRI = "CAST(date + to_days(CAST((12 - isodow(date)) % 7 AS INTEGER)) AS DATE)"
case("market_payload", "market kind key week " + _PAGE, _market_page,
     f"""WITH s AS (SELECT market, 'bucket' AS kind, bucket AS key, date, cum_linked_bp AS o, CASE WHEN count(r_be_bp) OVER (PARTITION BY market, bucket) > 0 THEN cum_be_bp END AS b, CASE WHEN gc > 0 THEN linked_fin_bp / gc END AS l,
       CASE WHEN gc > 0 AND count(r_be_bp) OVER (PARTITION BY market, bucket) > 0 THEN nominal_fin_bp / gc END AS n FROM bk_series
       UNION ALL SELECT r.market, 'bond', CAST(r.bond_id AS VARCHAR), r.date, r.cum_bp, q.cum_be_bp, CASE WHEN r.gc > 0 THEN r.fin_bp / r.gc END, CASE WHEN q.gc > 0 THEN q.nominal_fin_bp / q.gc END
       FROM bond_rets r LEFT JOIN pair_rets q ON q.real_id = r.bond_id AND q.date = r.date WHERE r.linked),
     c AS (SELECT *, sum(l) OVER w AS sl, sum(n) OVER w AS sn FROM s WINDOW w AS (PARTITION BY market, kind, key ORDER BY date)),
     k AS (SELECT market, kind, key, {_FRI} AS week, arg_max(o, date) FILTER (o IS NOT NULL) AS o, arg_max(b, date) FILTER (b IS NOT NULL) AS b, arg_max(sl, date) FILTER (l IS NOT NULL) AS sl, arg_max(sn, date) FILTER (n IS NOT NULL) AS sn FROM c GROUP BY 1, 2, 3, 4),
     u AS (SELECT {_FRI} AS week, arg_max(c, date) AS crude FROM (SELECT date, sum(usd_per_contract) OVER (ORDER BY date) AS c FROM crude_spl) GROUP BY 1),
     h AS (SELECT market, bucket, b_slope AS crude_b FROM (SELECT market, bucket, {ols('x_usd', 'be_usd', 'b_')} FROM pairs_bk GROUP BY 1, 2) WHERE b_n >= 30)
     SELECT k.market, kind, key, CAST(k.week AS VARCHAR) AS week, round_even(o, 0) AS "out", round_even(b, 0) AS be, round_even(sl, 0) AS slip_l, round_even(sn, 0) AS slip_n, CASE WHEN crude_b IS NOT NULL THEN round_even(crude, 0) END AS crude, round(crude_b, 4) AS crude_b
     FROM k LEFT JOIN h ON h.market = k.market AND h.bucket = k.key AND kind = 'bucket' LEFT JOIN u USING (week) WHERE o IS NOT NULL""")

# ------------------------------------------------------------------ raw exports
case("import_pair_map", "status real_id nominal_id beta:2 note beta_1m:2 beta_3m:2", lambda p: cleaning.import_pair_map(cleaning.comparator_report(p.bonds), landed.build_universe(p.bonds, p.conv, p.idle)),
     """WITH a AS (SELECT bond_id, country FROM fx_static WHERE linked AND NOT deferred AND bond_id % 41 <> 8),
     r AS (SELECT bond_id FROM fx_static WHERE linked AND bond_id % 10 <> 6 AND bond_id % 14 <> 0)
     SELECT 'mapped' AS status, CAST(r.bond_id AS VARCHAR) AS real_id, CAST(r.bond_id + 1 AS VARCHAR) AS nominal_id, 1.0 AS beta, 'L' || r.bond_id || ' vs N' || (r.bond_id + 1) AS note,
       0.5 + (r.bond_id % 5) / 10.0 AS beta_1m, 0.6 + (r.bond_id % 4) / 10.0 AS beta_3m FROM r JOIN a USING (bond_id) WHERE country <> 'DE'
     UNION ALL SELECT 'unmatched', CAST(bond_id AS VARCHAR), NULL, NULL, NULL, NULL, NULL FROM r WHERE bond_id NOT IN (SELECT bond_id FROM a)
     UNION ALL SELECT 'uncovered', CAST(bond_id AS VARCHAR), NULL, NULL, NULL, NULL, NULL FROM a WHERE country <> 'DE' AND bond_id NOT IN (SELECT bond_id FROM r)""")
case("import_nominal_universe", "isin coupon:4 maturity:d issue_date:d ticker amt_issued:0 country", lambda p: cleaning.import_nominal_universe(
        cleaning.bond_export(p.bonds), p.bonds.where("linked AND bond_id % 16 <> 2 AND bond_id % 16 <> 4").select(cleaning.isin_of(F.col("bond_id"), F.col("country")).alias("isin")),
        p.bonds.where("bond_id % 31 = 1").select(cleaning.isin_of(F.col("bond_id"), F.col("country")).alias("isin"))),
     """SELECT country || lpad(CAST(bond_id AS VARCHAR), 10, '0') AS isin, coupon, maturity, issue AS issue_date,
     CASE WHEN bond_id % 8 = 2 AND linked THEN 'BTPi' WHEN bond_id % 8 = 4 AND linked THEN 'OAT€i' ELSE 'GOVT' END AS ticker, amt_issued, country
     FROM fx_static WHERE bond_id % 19 <> 3 AND bond_id % 29 <> 7 AND bond_id % 31 <> 1 AND (NOT linked OR bond_id % 16 = 2)""")
case("parse_gilt_ops", "bond_id event_date:d event_type amount:0 reopening", lambda p: cleaning.parse_gilt_ops(cleaning.operation_lines(p.spark, p.sf_dir), p.bonds.where("linked").select("bond_id", "coupon", "maturity")),
     """WITH o AS (SELECT o_orderkey AS k, date, b.coupon, b.maturity, round(o_totalprice / 100, 4) AS amt FROM fx_orders JOIN fx_static b ON b.bond_id = (o_custkey // 30) * 2),
     v AS (SELECT * FROM o WHERE k % 11 <> 4 AND k % 13 <> 6 AND k % 7 <> 5),
     i AS (SELECT coupon, year(maturity) AS y, min(bond_id) AS bond_id FROM fx_static WHERE linked GROUP BY 1, 2),
     m AS (SELECT i.bond_id, v.date, v.amt, CASE k % 3 WHEN 2 THEN 'syndication' WHEN 1 THEN 'tender' ELSE 'auction' END AS method FROM v JOIN i ON i.coupon = v.coupon AND i.y = year(v.maturity)),
     d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bond_id, date ORDER BY amt, method) AS n FROM m) WHERE n = 1),
     f AS (SELECT *, min(date) OVER (PARTITION BY bond_id) AS lo FROM d)
     SELECT bond_id, date AS event_date, CASE WHEN date <> lo THEN 'reopening' ELSE method END AS event_type, round(amt * 1e6, 0) AS amount, date <> lo AS reopening FROM f""")
case("scan_tap_files", "isin country market event_date:d event_type amount:2 reopening source", lambda p: cleaning.tap_file_round_trip(p.spark, p.taps),
     "SELECT country || lpad(CAST(bond_id AS VARCHAR), 10, '0') AS isin, country, market, event_date, CASE WHEN country <> 'GB' THEN 'tap' END AS event_type, amount, true AS reopening, 'dmo' AS source FROM fx_events")
