"""Shared SQL steps of the oracle, written separately from the Spark plans.

Bodies are plain DuckDB SQL; ``expand`` puts the ones a query names (and what those name) in front.
"""

from __future__ import annotations

import re

from realcurve.functions.daycount import BUCKET_TARGETS
from realcurve.operators.cmt import MARKET_COUNTRY
from realcurve.sources import conventions as cv

EMIT = "DATE '1996-01-01'"
AS_OF = "DATE '2001-12-01'"
LAST_MONTH = "(SELECT CAST(date_trunc('month', max(l_shipdate)) AS DATE) FROM lineitem)"

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def expand(sql: str) -> str:
    """Prefix a query with the steps it uses, in dependency order."""
    names = re.compile(r"\b(" + "|".join(sorted(CTES, key=len, reverse=True)) + r")\b")
    order: list[str] = []

    def need(text: str, trail: tuple[str, ...] = ()) -> None:
        for n in dict.fromkeys(names.findall(text)):
            if n in order or n in trail:
                continue
            need(CTES[n], (*trail, n))
            order.append(n)

    need(sql)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in order) + "\n" + sql


def label_sql(y: str, long_end: str | None) -> str:
    r = f"round_even({y}, 0)"
    edges = [(3, "2y"), (5, "5y"), (8, "7y"), (11, "10y"), (13, "12y"), (17, "15y"), (22, "20y"), (27, "25y")]
    body = " ".join(f"WHEN {r} <= {e} THEN '{n}'" for e, n in edges)
    if long_end is None:
        return f"CASE WHEN {y} IS NULL OR {y} < 1.5 THEN NULL {body} ELSE '30y' END"
    return (f"CASE WHEN {y} IS NULL OR {y} < 1.5 THEN NULL {body} WHEN NOT ({long_end}) THEN '30y' "
            f"WHEN {r} <= 34 THEN '30y' WHEN {r} <= 44 THEN '40y' ELSE '50y' END")


LONG = "market IN (" + ", ".join(f"'{m}'" for m in cv.LONG_END_MARKETS) + ")"

# ------------------------------------------------------------------ landed shapes
cte("fx_bonds", """
SELECT s_suppkey AS bond_id, s_suppkey % 2 = 0 AS linked,
  CASE WHEN s_suppkey % 2 = 0 THEN 'linked' ELSE 'nominal' END AS leg,
  CAST([5,10,30][((s_suppkey // 2) % 3) + 1] AS INTEGER) AS ty,
  CAST([5,10,30][((s_suppkey // 2) % 3) + 1] AS VARCHAR) || 'y' AS tenor,
  ['FR','IT','ES','DE','GB'][s_nationkey % 5 + 1] AS country,
  CASE WHEN s_suppkey % 2 = 1 THEN NULL
    WHEN s_nationkey % 5 = 0 THEN CASE WHEN (s_suppkey // 10) % 2 = 0 THEN 'FR_OATEI' ELSE 'FR_OATI' END
    WHEN s_nationkey % 5 = 1 THEN CASE WHEN s_suppkey % 17 = 4 THEN 'IT_ITALIA' ELSE 'IT_BTPEI' END
    WHEN s_nationkey % 5 = 2 THEN 'ES_EI' WHEN s_nationkey % 5 = 3 THEN 'DE_EI'
    ELSE CASE WHEN s_suppkey % 19 = 6 THEN 'UK_8M' ELSE 'UK_3M' END END AS market,
  CAST(1 + (s_suppkey // 3) % 2 AS INTEGER) AS static_freq, 0.25 * (1 + s_suppkey % 16) AS coupon,
  CAST(DATE '1995-06-15' + to_months(CAST(7 * s_suppkey % 36 AS INTEGER)) AS DATE) AS dated,
  CAST(DATE '1995-06-15' + to_months(CAST(7 * s_suppkey % 36 AS INTEGER)) AS DATE) AS issue,
  CAST(DATE '1995-06-15' + to_months(CAST(7 * s_suppkey % 36 + 12 * [5,10,30][((s_suppkey // 2) % 3) + 1] AS INTEGER)) AS DATE) AS maturity,
  CAST(100 + s_suppkey % 7 AS DOUBLE) AS base_index, 1e9 * (1 + s_suppkey % 9) AS amt_issued,
  1e9 * (1 + s_suppkey % 9) + 5e8 * (s_suppkey % 4) AS amt_out
FROM supplier""")
cte("fx_static", """
SELECT *, COALESCE(market, 'NOM_' || country) AS conv_id, CASE WHEN linked THEN 'US_LINKED' ELSE 'US_NOMINAL' END AS us_conv_id,
  COALESCE(market IN ('IT_ITALIA', 'UK_8M'), false) AS deferred
FROM fx_bonds""")
cte("fx_quotes", """
SELECT l_suppkey AS bond_id, CAST(l_shipdate AS DATE) AS date,
  90.0 + 2.0 * (CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*)) AS clean,
  0.5 + 0.5 * (CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*)) AS ytm,
  CASE WHEN CAST(l_shipdate AS DATE) >= DATE '2000-01-01' THEN 1.0 + CAST(sum(l_linenumber) AS DOUBLE) / count(*) / 1000.0 END AS vendor_ir
FROM lineitem GROUP BY 1, CAST(l_shipdate AS DATE)""")
cte("fx_revised", """
WITH e AS (SELECT user_id AS bond_id, DATE '1996-01-01' + CAST(event_id * 37 % 2000 AS INTEGER) AS date, arg_max(90.0 + value / 100.0, (ts, event_id)) AS c, arg_max(0.5 + (event_id % 50) / 100.0::DOUBLE, (ts, event_id)) AS y FROM events GROUP BY 1, 2)
SELECT bond_id, date, coalesce(c, clean) AS clean, coalesce(y, ytm) AS ytm, vendor_ir FROM fx_quotes FULL JOIN e USING (bond_id, date)""")
cte("fx_orders", "SELECT *, CAST(o_orderdate AS DATE) AS date FROM orders")
cte("fx_status", """
SELECT o_orderstatus AS st, date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 / 1e5 AS value
FROM fx_orders WHERE isodow(date) < 6 GROUP BY 1, 2""")
cte("fx_share", """
SELECT m AS date, CAST(sum(n) OVER (ORDER BY m) AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS share
FROM (SELECT last_day(date) AS m, count(*) AS n FROM fx_orders GROUP BY 1)""")
cte("fx_series", """
SELECT 'gcf_treasury' AS series_id, date, value FROM fx_status WHERE st = 'F' AND date >= DATE '1996-03-01'
UNION ALL SELECT 'estr_gc', date, value FROM fx_status WHERE st = 'F' AND date >= DATE '1998-01-01'
UNION ALL SELECT 'rfr_de', date, value FROM fx_status WHERE st = 'F' AND date >= DATE '1999-01-01' AND day(date) <= 20
UNION ALL SELECT 'rfr_fr', date, value FROM fx_status WHERE st = 'F' AND date >= DATE '1999-06-01'
UNION ALL SELECT 'gc_repo_on', date, value FROM fx_status WHERE st = 'O'
UNION ALL SELECT 'eonia', date, value FROM fx_status WHERE st = 'O'
UNION ALL SELECT 'rfr_it', date, value FROM fx_status WHERE st = 'O' AND date >= DATE '1998-06-01' AND day(date) > 5
UNION ALL SELECT 'fed_funds', date, value FROM fx_status WHERE st = 'P'
UNION ALL SELECT 'sonia_gc', date, value FROM fx_status WHERE st = 'P'
UNION ALL SELECT s, date, 100.0 * (1.0 + p * share) FROM fx_share, (VALUES ('cpi_nsa', 0.30::DOUBLE), ('EUR_HICPXT', 0.20::DOUBLE),
  ('FR_CPIXT', 0.25::DOUBLE), ('UK_RPI', 0.35::DOUBLE), ('IT_FOIXT', 0.22::DOUBLE)) v(s, p)
  WHERE NOT (s = 'UK_RPI' AND date = DATE '1998-07-31')""")
cte("fx_conv", f"SELECT * FROM (VALUES {cv.values_clause(cv.LINKED_MARKETS + cv.NOMINAL_MARKETS + cv.US_MARKETS)}) t({', '.join(cv.CONV_COLUMNS)})")
cte("fx_printed", """
SELECT DISTINCT c AS cal_id, date FROM fx_series, (VALUES ('US', 'fed_funds'), ('TARGET2', 'eonia'), ('UK', 'sonia_gc')) v(c, s) WHERE series_id = s""")
cte("fx_cal", """
SELECT cal_id, date, CAST(row_number() OVER (PARTITION BY cal_id ORDER BY date) AS INTEGER) AS seq FROM (
  SELECT cal_id, date FROM fx_printed
  UNION SELECT cal_id, d FROM (SELECT cal_id, CAST(unnest(generate_series(max(date) + 1, max(date) + 400, INTERVAL 1 DAY)) AS DATE) AS d FROM fx_printed GROUP BY cal_id)
  WHERE isodow(d) < 6)""")
cte("us_cal", "SELECT date, seq FROM fx_cal WHERE cal_id = 'US'")
_rungs = [(repo, i, s, x) for repo, many in cv.REPO_LADDERS.items() for i, (s, x) in enumerate(many)]
cte("fx_repo", f"""
SELECT repo_id, date, arg_min(value + spread, rung) AS rate FROM fx_series
JOIN (VALUES {cv.values_clause(_rungs)}) v(repo_id, rung, sid, spread) ON series_id = sid GROUP BY 1, 2""")
cte("fx_levels", """
SELECT series_id AS index_id, CAST(date_trunc('month', date) AS DATE) AS month, value AS level FROM fx_series
WHERE series_id IN ('cpi_nsa', 'EUR_HICPXT', 'FR_CPIXT', 'UK_RPI', 'IT_FOIXT')""")


def dri(day: str, index: str, lag: str, interp: str) -> str:
    """Scalar subqueries for the two index months of a day."""
    at = lambda k: (f"(SELECT level FROM fx_levels z WHERE z.index_id = {index} AND z.month = "  # noqa: E731
                    f"CAST(date_trunc('month', {day}) - to_months(CAST({k} AS INTEGER)) AS DATE))")
    lo, hi = at(lag), at(f"{lag} - 1")
    return f"CASE WHEN {interp} THEN {lo} + (day({day}) - 1)::DOUBLE / day(last_day({day})) * ({hi} - {lo}) ELSE {lo} END"


def metrics(prefix: str, conv_key: str, quotes: str = "fx_quotes") -> None:
    """Valued quotes under the conventions of ``conv_key``; the price is summed coupon by coupon."""
    cte(f"{prefix}_settled", f"""
WITH j AS (
  SELECT q.*, b.* EXCLUDE (bond_id), c.* EXCLUDE (country, deferred, conv_id), c.conv_id AS ck,
    COALESCE(c.freq, CASE WHEN static_freq > 0 THEN static_freq END, freq_default, 2) AS f
  FROM {quotes} q JOIN fx_static b USING (bond_id) JOIN fx_conv c ON c.conv_id = b.{conv_key}
  WHERE q.clean IS NOT NULL AND q.ytm IS NOT NULL),
n AS (SELECT j.*, k.seq AS s0 FROM j ASOF JOIN fx_cal k ON j.cal_id = k.cal_id AND j.date < k.date),
t AS (SELECT n.*, least(s0 + settle_lag - 1, (SELECT max(seq) FROM fx_cal y WHERE y.cal_id = n.cal_id)) AS sq FROM n)
SELECT t.*, k.date AS settle FROM t JOIN fx_cal k ON k.cal_id = t.cal_id AND k.seq = t.sq
WHERE k.date >= t.dated AND k.date < t.maturity""")
    cte(f"{prefix}_dri", f"""
SELECT settle, index_id, lag_months, interp, {dri('o.settle', 'o.index_id', 'o.lag_months', 'o.interp')} AS dri
FROM (SELECT DISTINCT settle, index_id, lag_months, interp FROM {prefix}_settled WHERE index_id IS NOT NULL) o""")
    cte(f"{prefix}_base", f"""
SELECT bond_id, {dri('o.dated', 'o.index_id', 'o.lag_months', 'o.interp')} AS dri_base
FROM (SELECT DISTINCT bond_id, dated, index_id, lag_months, interp FROM {prefix}_settled WHERE index_id IS NOT NULL) o""")
    eom = lambda months: f"CASE WHEN maturity = last_day(maturity) THEN last_day(CAST(maturity - to_months(CAST({months} AS INTEGER)) AS DATE)) ELSE CAST(maturity - to_months(CAST({months} AS INTEGER)) AS DATE) END"
    cte(f"{prefix}_grid", f"""
WITH g AS (
  SELECT bond_id, dated, maturity, f, unnest([k * (12 // f) for k in range(0, 130)]) AS back
  FROM (SELECT DISTINCT bond_id, dated, maturity, f FROM {prefix}_settled))
SELECT bond_id, list_sort(list_append(list(d), any_value(dated))) AS anchors FROM (SELECT *, {eom('back')} AS d FROM g) WHERE d > dated GROUP BY bond_id""")
    price = lambda y: f"(coupon / f) * list_sum([pow(1 + {y}, -(k + w)) for k in range(0, n_left)]) + 100.0 * pow(1 + {y}, -(n_left - 1 + w))"
    cte(f"{prefix}_metrics", f"""
WITH a AS (
  SELECT s.*, d.dri, e.dri_base,
    len([x for x in anchors if x <= s.settle]) AS pos, anchors
  FROM {prefix}_settled s JOIN {prefix}_grid USING (bond_id)
  LEFT JOIN {prefix}_dri d ON d.settle = s.settle AND d.index_id = s.index_id AND d.lag_months = s.lag_months AND d.interp = s.interp
  LEFT JOIN {prefix}_base e ON e.bond_id = s.bond_id),
p AS (
  SELECT *, anchors[pos] AS pa, anchors[pos + 1] AS na, len(anchors) - pos AS n_left FROM a WHERE pos >= 1 AND pos < len(anchors)),
w AS (
  SELECT *, (na - settle)::DOUBLE / (na - pa) AS w,
    CASE WHEN index_id IS NULL THEN 1.0 WHEN rounding = 'trunc' THEN floor((floor(dri / base_index * 1e6) + 5) / 10) / 1e5
      WHEN dri_base <> 0 THEN round_even(dri / dri_base * 1e5, 0) / 1e5 END AS index_ratio
  FROM p)
SELECT *, coupon / f * (1 - w) AS accrued, clean + coupon / f * (1 - w) AS dirty_real,
  (clean + coupon / f * (1 - w)) * index_ratio AS V,
  ({price('(ytm - 0.005) / 100.0 / f')} - ({price('(ytm + 0.005) / 100.0 / f')})) * index_ratio AS dv01
FROM w""")


metrics("mx", "conv_id")
metrics("mu", "us_conv_id")
metrics("mr", "conv_id", "fx_revised")

for pre in ("mx", "mu", "mr"):
    cte(f"{pre}_lag", f"""
SELECT * EXCLUDE (pays), CASE WHEN coalesce(dv01_prev, 0) <> 0 THEN dv01_prev ELSE dv01 END AS denom0,
  len([x for x in pays if x > settle_prev AND x <= settle]) AS paid
FROM (
  SELECT m.* EXCLUDE (anchors), list_slice(anchors, 2, 200) AS pays, lag(date) OVER k AS prev_date, lag(V) OVER k AS V_prev, lag(settle) OVER k AS settle_prev, lag(dv01) OVER k AS dv01_prev
  FROM {pre}_metrics m WINDOW k AS (PARTITION BY bond_id ORDER BY date))""")

cte("gc_days", """
SELECT repo_id, date, last_value(rate IGNORE NULLS) OVER (PARTITION BY repo_id ORDER BY date) AS gc
FROM (SELECT repo_id, CAST(unnest(generate_series(min(date), max(date) + 400, INTERVAL 1 DAY)) AS DATE) AS date FROM fx_repo GROUP BY repo_id)
LEFT JOIN fx_repo USING (repo_id, date)""")


def returns_sql(source: str) -> str:
    return f"""
SELECT r.*, gc, (settle - settle_prev) AS days, V - V_prev AS dV, paid * (coupon / f) * index_ratio AS coupon_cash,
  coalesce((settle - settle_prev) / 360.0 * (gc / 100.0) * V_prev, 0.0) AS financing,
  ((settle - settle_prev) / 360.0 * V_prev / 10000.0) / denom AS fin_sens,
  V - V_prev + paid * (coupon / f) * index_ratio - coalesce((settle - settle_prev) / 360.0 * (gc / 100.0) * V_prev, 0.0) AS pnl
FROM {source} r LEFT JOIN gc_days USING (repo_id, date)
WHERE prev_date IS NOT NULL AND V IS NOT NULL AND V_prev IS NOT NULL AND denom IS NOT NULL AND denom <> 0"""


def bp_cols(source: str) -> str:
    return f"SELECT *, (dV + coupon_cash) / denom AS gross_bp, financing / denom AS fin_bp, pnl / denom AS bp, 1e7 / denom AS notional, coupon_cash <> 0 AS is_coupon FROM ({source})"


cte("mx_epoch", "SELECT *, first_value(denom0) OVER (PARTITION BY bond_id, date_trunc('month', date) ORDER BY date) AS denom FROM mx_lag")
cte("mr_epoch", "SELECT *, first_value(denom0) OVER (PARTITION BY bond_id, date_trunc('month', date) ORDER BY date) AS denom FROM mr_lag")
cte("revised_rets", f"SELECT *, sum(bp) OVER (PARTITION BY bond_id ORDER BY date) AS cum_bp FROM ({bp_cols(returns_sql('mr_epoch'))})")
cte("bond_rets", f"SELECT *, sum(bp) OVER (PARTITION BY bond_id ORDER BY date) AS cum_bp FROM ({bp_cols(returns_sql('mx_epoch'))})")

# ------------------------------------------------------------------ auctions and rolls
cte("fx_supply", """
SELECT (o_custkey // 30) * 2 AS bond_id, date AS auction_date, o_orderkey % 2 = 1 AS reopening, o_totalprice * 1e4 AS offering FROM (
  SELECT *, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY o_totalprice DESC, o_orderkey) AS rn
  FROM fx_orders WHERE isodow(date) < 6 AND day(date) BETWEEN 10 AND 28) WHERE rn = 1""")
cte("fx_auctions", """
SELECT bond_id, leg, tenor, dated - 3 AS auction_date, dated AS issue_date, dated AS dated_date, maturity AS maturity_date, false AS reopening,
  CASE WHEN bond_id % 13 = 5 THEN NULL WHEN bond_id % 11 = 3 THEN 2.5e7 WHEN bond_id % 7 = 2 THEN 2.5e7 ELSE 2e9 + 1e7 * (bond_id % 50) END AS offering
FROM fx_static
UNION ALL SELECT s.bond_id, leg, tenor, auction_date, auction_date + 5, dated, maturity, reopening, offering
FROM fx_supply s JOIN fx_static b USING (bond_id) WHERE auction_date > dated""")
cte("new_iss", """
SELECT * FROM (SELECT leg, tenor, bond_id, issue_date, auction_date, maturity_date,
  row_number() OVER (PARTITION BY leg, tenor, bond_id ORDER BY issue_date, auction_date, maturity_date) AS rn FROM fx_auctions WHERE issue_date IS NOT NULL) WHERE rn = 1""")
cte("iss_min", "SELECT bond_id, min(issue_date) AS issue_date FROM fx_auctions GROUP BY 1")
cte("roll_lk_raw", """
SELECT leg, tenor, c.date AS eff, issue_date, bond_id, maturity_date
FROM (SELECT *, CAST(date_trunc('month', issue_date) + INTERVAL 1 MONTH AS DATE) AS nm FROM new_iss WHERE leg = 'linked') n
ASOF JOIN us_cal c ON n.nm <= c.date""")


def collapse(src: str) -> str:
    return f"""
SELECT leg, tenor, eff, issue_date, bond_id, maturity_date FROM (
  SELECT *, lag(bond_id) OVER (PARTITION BY leg, tenor ORDER BY eff) AS pb FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY leg, tenor, eff ORDER BY issue_date DESC, bond_id DESC) AS k FROM {src}) WHERE k = 1))
WHERE pb IS NULL OR pb <> bond_id"""


cte("roll_lk", collapse("roll_lk_raw"))
cte("roll_nb", """
SELECT 'nominal' AS leg, tenor, eff, issue_date, bond_id, maturity_date FROM (
  SELECT r.tenor, r.eff, n.issue_date, n.bond_id, n.maturity_date,
    row_number() OVER (PARTITION BY r.tenor, r.eff ORDER BY n.issue_date DESC, n.bond_id DESC) AS k
  FROM roll_lk r JOIN new_iss n ON n.leg = 'nominal' AND n.tenor = r.tenor AND n.issue_date <= r.eff WHERE r.tenor <> '10y') WHERE k = 1""")
cte("roll_nm", """
WITH lk AS (SELECT CAST(date_trunc('month', eff) AS DATE) AS month, eff, maturity_date FROM roll_lk WHERE tenor = '10y'),
ni AS (SELECT * FROM new_iss WHERE leg = 'nominal' AND tenor = '10y'),
g AS (SELECT CAST(unnest(generate_series((SELECT min(month) FROM lk), (SELECT date_trunc('month', greatest((SELECT max(month) FROM lk), (SELECT max(issue_date) FROM ni))) + INTERVAL 2 MONTH), INTERVAL 1 MONTH)) AS DATE) AS month),
t AS (SELECT g.month, (SELECT arg_max(maturity_date, month) FROM lk WHERE lk.month <= g.month) AS target, coalesce((SELECT max(eff) FROM lk WHERE lk.month = g.month), g.month) AS cutoff FROM g)
SELECT 'nominal' AS leg, '10y' AS tenor, cutoff AS eff, issue_date, bond_id, maturity_date FROM (
  SELECT t.*, n.bond_id, n.issue_date, n.maturity_date,
    row_number() OVER (PARTITION BY t.month ORDER BY CASE WHEN n.maturity_date >= t.target THEN 0 ELSE 1 END, abs(n.maturity_date - t.target), n.issue_date DESC, n.bond_id DESC) AS k
  FROM t JOIN ni n ON n.issue_date <= t.cutoff) WHERE k = 1""")
cte("roll_all", "SELECT leg, tenor, eff, issue_date, bond_id, maturity_date FROM roll_lk_raw UNION ALL SELECT * FROM roll_nb UNION ALL SELECT * FROM roll_nm")
cte("roll_sched", collapse("roll_all"))
cte("roll_span", """
WITH e AS (
  SELECT r.leg, r.tenor, r.bond_id, greatest(r.eff, c.date) AS eff
  FROM (SELECT r.*, i.issue_date AS first_issue FROM roll_sched r JOIN iss_min i USING (bond_id)) r ASOF JOIN us_cal c ON r.first_issue < c.date),
d AS (SELECT *, lag(bond_id) OVER (PARTITION BY leg, tenor ORDER BY eff, bond_id) AS pb FROM e),
k AS (SELECT leg, tenor, bond_id, eff, lead(eff) OVER (PARTITION BY leg, tenor ORDER BY eff, bond_id) AS next_eff FROM d WHERE pb IS NULL OR pb <> bond_id)
SELECT * FROM k WHERE next_eff IS NULL OR next_eff > eff""")
cte("leg_rows", """
SELECT h.* EXCLUDE (leg, tenor), s.leg AS leg, s.tenor AS tenor, s.eff FROM roll_span s JOIN mu_lag h
ON h.bond_id = s.bond_id AND h.date >= s.eff AND (s.next_eff IS NULL OR h.date < s.next_eff)""")
cte("leg_epoch", "SELECT *, first_value(denom0) OVER (PARTITION BY leg, tenor, eff, date_trunc('month', date) ORDER BY date) AS denom FROM leg_rows")
cte("leg_rets", f"""
SELECT * FROM (SELECT *, coalesce(lag(bond_id) OVER (PARTITION BY leg, tenor ORDER BY date) <> bond_id, false) AS is_roll
FROM ({bp_cols(returns_sql('leg_epoch'))})) WHERE date >= {EMIT}""")
cte("tenor_rets", """
WITH b AS (
  SELECT coalesce(t.tenor, u.tenor) AS tenor, coalesce(t.date, u.date) AS date, t.bp AS r_linked_bp, u.bp AS r_nominal_bp,
    t.fin_sens AS s_linked, u.fin_sens AS s_nominal, coalesce(t.days, u.days) AS days, t.bp - u.bp AS r_be_bp
  FROM (SELECT * FROM leg_rets WHERE leg = 'linked') t FULL JOIN (SELECT * FROM leg_rets WHERE leg = 'nominal') u ON t.tenor = u.tenor AND t.date = u.date)
SELECT *, CASE WHEN r_linked_bp IS NOT NULL THEN sum(r_linked_bp) OVER w END AS cum_linked_bp,
  CASE WHEN r_nominal_bp IS NOT NULL THEN sum(r_nominal_bp) OVER w END AS cum_nominal_bp,
  CASE WHEN r_be_bp IS NOT NULL THEN sum(r_be_bp) OVER w END AS cum_be_bp
FROM b WINDOW w AS (PARTITION BY tenor ORDER BY date)""")

# ------------------------------------------------------------------ seasonality
cte("real_auc", "SELECT * FROM fx_auctions WHERE leg = 'linked' AND (offering IS NULL OR offering >= 1e9)")
cte("anchor_m", f"""
SELECT CAST(date_trunc('month', auction_date) AS DATE) AS month, auction_date AS auction, NOT reopening AS new_issue FROM (
  SELECT *, row_number() OVER (PARTITION BY date_trunc('month', auction_date) ORDER BY auction_date, issue_date DESC, bond_id DESC) AS k
  FROM real_auc WHERE auction_date >= {EMIT}) WHERE k = 1""")
cte("anchors5", """
WITH r AS (
  SELECT m.*, (SELECT max(date) FROM us_cal WHERE date < m.month) AS a0, (SELECT max(date) FROM us_cal WHERE date <= m.auction - 7) AS x1,
    coalesce((SELECT min(date) FROM us_cal WHERE date >= m.auction + 7), (SELECT max(date) FROM us_cal)) AS x3,
    (SELECT max(date) FROM us_cal WHERE date <= last_day(m.month)) AS a4 FROM anchor_m m)
SELECT month, new_issue, a0, CASE WHEN x1 <= a0 THEN a0 ELSE x1 END AS a1, auction AS a2, CASE WHEN x3 >= a4 THEN a4 ELSE x3 END AS a3, a4,
  (x3 >= a4 OR x1 <= a0) AS clamped, CASE WHEN x1 <= a0 THEN 'early' WHEN x3 >= a4 THEN 'late' END AS kind FROM r""")
cte("fx_fut", """
WITH d AS (
  SELECT date, 50.0 + CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 / 1e4 AS front,
    CAST(date_trunc('month', date) + to_months(CASE WHEN day(date) >= 20 THEN 2 ELSE 1 END) AS DATE) AS front_gen
  FROM fx_orders WHERE isodow(date) < 6 GROUP BY date)
SELECT date, front, CASE WHEN day(date) <> 28 THEN 1.01 * front END AS second, front_gen,
  CASE WHEN day(date) % 9 <> 0 THEN CAST(front_gen + to_months(CASE WHEN day(date) = 19 THEN 2 ELSE 1 END) AS DATE) END AS second_gen FROM d""")
cte("fut_lag", """
SELECT *, lag(date) OVER w AS pd, lag(front) OVER w AS pf, lag(second) OVER w AS ps, lag(front_gen) OVER w AS pfg, lag(second_gen) OVER w AS psg
FROM fx_fut WHERE date IN (SELECT date FROM us_cal) WINDOW w AS (ORDER BY date)""")


def splice(roll: str, mark: str, mult: str) -> str:
    return f"""
SELECT *, sum(r_bp) OVER (ORDER BY date) AS cum_bp FROM (
  SELECT date, front, second, prior_mark, date - pd AS days, is_roll, front - prior_mark AS chg, (front - prior_mark) * {mult} AS usd_per_contract,
    (front - prior_mark) / prior_mark * 1e4 AS r_bp
  FROM (SELECT *, {mark} AS prior_mark FROM (SELECT *, {roll} AS is_roll FROM fut_lag WHERE pd IS NOT NULL))
  WHERE prior_mark IS NOT NULL AND prior_mark <> 0 AND date >= {EMIT})"""


cte("gas_spl", splice("date_trunc('month', date) <> date_trunc('month', pd)", "CASE WHEN is_roll THEN ps ELSE pf END", "420.0"))
cte("crude_spl", splice("coalesce(front_gen <> pfg, false)", "CASE WHEN NOT is_roll THEN pf WHEN psg IS NULL OR psg = front_gen THEN ps END", "1000.0"))
cte("seas", """
WITH d AS (
  SELECT r.tenor, a.month, a.clamped, a.new_issue, r.r_linked_bp, r.r_nominal_bp, r.s_linked, r.s_nominal, coalesce(g.usd_per_contract, 0.0) AS g,
    CASE WHEN r.date <= a1 THEN 1 WHEN r.date <= a2 THEN 2 WHEN r.date <= a3 THEN 3 ELSE 4 END AS period
  FROM tenor_rets r JOIN anchors5 a ON a.month = date_trunc('month', r.date) LEFT JOIN gas_spl g ON g.date = r.date),
m AS (SELECT DISTINCT tenor, month, clamped, new_issue FROM d)
SELECT m.tenor, m.month, p.period, any_value(m.clamped) AS clamped, any_value(m.new_issue) AS new_issue,
  CASE WHEN count(r_linked_bp) = count(d.tenor) THEN sum(r_linked_bp) END AS linked_pnl, CASE WHEN count(r_nominal_bp) = count(d.tenor) THEN sum(r_nominal_bp) END AS nominal_pnl,
  CASE WHEN count(s_linked) = count(d.tenor) THEN sum(s_linked) END AS linked_slip, CASE WHEN count(s_nominal) = count(d.tenor) THEN sum(s_nominal) END AS nominal_slip,
  sum(g) AS gas_pnl, count(d.tenor) AS trading_days
FROM m CROSS JOIN (VALUES (1), (2), (3), (4)) p(period) LEFT JOIN d ON d.tenor = m.tenor AND d.month = m.month AND d.period = p.period GROUP BY 1, 2, 3""")
cte("seas_be", "SELECT *, linked_pnl - nominal_pnl AS value FROM seas")

# ------------------------------------------------------------------ hedge pairs
for nm, fut in (("gas", "gas_spl"), ("crude", "crude_spl")):
    cte(f"pairs_{nm}", f"""
SELECT * FROM (SELECT tenor, date, x_usd, linked_usd, nominal_usd, linked_usd - nominal_usd AS be_usd FROM (
  SELECT r.tenor, f.date, any_value(f.usd_per_contract) AS x_usd, sum(r_linked_bp) * 100000.0 AS linked_usd, sum(r_nominal_bp) * 100000.0 AS nominal_usd
  FROM tenor_rets r ASOF JOIN {fut} f ON r.date <= f.date GROUP BY 1, 2)) WHERE be_usd IS NOT NULL""")
    cte(f"pts_{nm}", f"SELECT tenor, date, x_usd AS x, be_usd AS y FROM pairs_{nm} WHERE be_usd IS NOT NULL")
cte("wf_rows", """
SELECT p.*, m.month, m.rebalance, y.w AS win, y.y AS years, CAST(m.rebalance - to_months(12 * y.y - 2) AS DATE) AS reach
FROM (SELECT * FROM pairs_gas WHERE be_usd IS NOT NULL) p
JOIN (SELECT tenor, CAST(date_trunc('month', date) AS DATE) AS month, min(date) AS rebalance FROM pairs_gas WHERE be_usd IS NOT NULL GROUP BY 1, 2) m ON m.tenor = p.tenor
CROSS JOIN (VALUES ('2y', 2), ('5y', 5)) y(w, y)
WHERE p.date >= CAST(m.rebalance - to_months(12 * y.y) AS DATE) AND p.date < m.rebalance""")


def ols(x: str, y: str, p: str = "") -> str:
    """Slope, intercept, r2, corr, t and n as plain sums of products."""
    ok = f"({x} IS NOT NULL AND {y} IS NOT NULL)"
    n = f"count(*) FILTER ({ok})"
    sxx, syy, sxy = f"regr_sxx({y}, {x})", f"regr_syy({y}, {x})", f"regr_sxy({y}, {x})"
    good = f"{n} >= 3 AND {sxx} > 0"
    return (f"CASE WHEN {good} THEN {sxy} / {sxx} END AS {p}slope, "
            f"CASE WHEN {good} THEN regr_avgy({y}, {x}) - {sxy} / {sxx} * regr_avgx({y}, {x}) END AS {p}intercept, "
            f"CASE WHEN {good} AND {syy} > 0 THEN {sxy} * {sxy} / ({sxx} * {syy}) END AS {p}r2, "
            f"CASE WHEN {good} AND {syy} > 0 THEN {sxy} / sqrt({sxx} * {syy}) END AS {p}corr, "
            f"CASE WHEN {good} AND ({syy} - {sxy} * {sxy} / {sxx}) > 0 THEN {sxy} / {sxx} / sqrt(({syy} - {sxy} * {sxy} / {sxx}) / ({n} - 2) / {sxx}) END AS {p}tstat, "
            f"{n} AS {p}n")


cte("wf", f"""
SELECT * FROM (SELECT tenor, month, rebalance, win, years, reach, count(*) AS rows, min(date) AS lo, {ols('x_usd', 'be_usd')},
  {ols('x_usd', 'linked_usd', 'l_')}, {ols('x_usd', 'nominal_usd', 'u_')} FROM wf_rows GROUP BY 1, 2, 3, 4, 5, 6)
WHERE rows >= 5 * years AND lo <= reach""")
cte("wf_legs", """
SELECT tenor, month, rebalance, max(CASE WHEN win = '2y' THEN l_slope END) AS b_linked_2y, max(CASE WHEN win = '2y' THEN u_slope END) AS b_nominal_2y,
  coalesce(max(CASE WHEN win = '2y' THEN rows END), 0) AS n_2y, max(CASE WHEN win = '5y' THEN l_slope END) AS b_linked_5y,
  max(CASE WHEN win = '5y' THEN u_slope END) AS b_nominal_5y, coalesce(max(CASE WHEN win = '5y' THEN rows END), 0) AS n_5y
FROM wf GROUP BY 1, 2, 3""")
cte("hedged_days", """
SELECT r.*, h.b_linked_2y AS bl, h.b_nominal_2y AS bn, coalesce(g.usd_per_contract, 0.0) AS gas
FROM tenor_rets r LEFT JOIN wf_legs h ON h.tenor = r.tenor AND h.month = date_trunc('month', r.date) LEFT JOIN gas_spl g ON g.date = r.date""")

# ------------------------------------------------------------------ issuance and buckets
cte("fx_taps", """
SELECT o_custkey // 15 AS bond_id, date AS event_date, o_totalprice, b.* EXCLUDE (bond_id)
FROM fx_orders JOIN fx_static b ON b.bond_id = o_custkey // 15 WHERE date >= dated AND date < maturity""")
cte("fx_events", """
SELECT bond_id, market, country, event_date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) * 100.0 AS amount
FROM fx_taps WHERE linked GROUP BY 1, 2, 3, 4""")
cte("iss_lines", """
SELECT market, country, bond_id, issue AS issue_date, year(issue) AS issue_year, maturity, year(maturity) AS maturity_year,
  CAST(round_even((maturity - issue) / 365.25, 0) AS INTEGER) AS orig_tenor, round(amt_issued / 1e9, 2) AS amt_issued_bn, round(amt_out / 1e9, 2) AS amt_out_bn
FROM fx_static WHERE linked AND NOT deferred AND bond_id % 41 <> 8""")
cte("iss_reop", """
SELECT l.market, e.bond_id, e.event_date, year(e.event_date) AS event_year, 'reopening' AS type, round(e.amount / 1e9, 2) AS amt_bn, orig_tenor,
  CAST(round_even((maturity - e.event_date) / 365.25, 0) AS INTEGER) AS remaining_tenor, maturity, 'taps' AS source
FROM fx_events e JOIN iss_lines l USING (bond_id)""")
cte("iss_events", """
SELECT market, bond_id, issue_date AS event_date, issue_year AS event_year, 'new' AS type, coalesce(amt_issued_bn, amt_out_bn) AS amt_bn, orig_tenor,
  orig_tenor AS remaining_tenor, maturity, 'static' AS source FROM iss_lines UNION ALL SELECT * FROM iss_reop""")
cte("iss_bucket", f"SELECT * FROM (SELECT *, {label_sql('((maturity - event_date) / 365.25)', LONG)} AS bucket FROM iss_events) WHERE bucket IS NOT NULL")
cte("first_ev", "SELECT market, bond_id, maturity, min(event_date) AS issued FROM iss_events GROUP BY 1, 2, 3")
cte("held_m", f"""
SELECT market, bucket, month, bond_id, maturity FROM (
  SELECT *, row_number() OVER (PARTITION BY market, bucket, month ORDER BY issued DESC, maturity DESC, bond_id DESC) AS k FROM (
    SELECT f.*, g.month, {label_sql('((maturity - g.month) / 365.25)', LONG)} AS bucket
    FROM first_ev f JOIN (SELECT CAST(unnest(generate_series(DATE '1995-01-01', {AS_OF}, INTERVAL 1 MONTH)) AS DATE) AS month) g
      ON f.issued <= g.month - 1 AND f.maturity >= g.month)
  WHERE bucket IS NOT NULL) WHERE k = 1""")
cte("nom_pool", """
WITH q AS (SELECT DISTINCT bond_id FROM fx_quotes),
s AS (SELECT bond_id, country, maturity, issue FROM fx_static WHERE NOT linked AND bond_id IN (SELECT bond_id FROM q)),
u AS (SELECT * FROM s WHERE country <> 'ES')
SELECT * FROM u UNION ALL SELECT * FROM s WHERE country NOT IN (SELECT country FROM u) AND bond_id IN (SELECT bond_id + 1 FROM fx_static WHERE linked)""")
_mc = ", ".join(f"('{m}', '{c}')" for m, c in MARKET_COUNTRY.items())
cte("held_n", f"""
SELECT * FROM (
  SELECT h.*, c.cty AS country, p.bond_id AS nominal_id, p.maturity AS nominal_maturity,
    row_number() OVER (PARTITION BY h.market, h.bucket, h.month ORDER BY abs(p.maturity - h.maturity), p.maturity, p.bond_id) AS k
  FROM held_m h JOIN (VALUES {_mc}) c(m, cty) ON c.m = h.market
  LEFT JOIN nom_pool p ON p.country = c.cty AND p.issue <= h.month - 1 AND p.maturity > h.month) WHERE k = 1""")
cte("bk_grid", """
SELECT g.market, s.bucket, g.date FROM (SELECT DISTINCT h.market, r.date FROM bond_rets r JOIN (SELECT DISTINCT market, bond_id FROM held_n) h ON h.bond_id = r.bond_id) g
JOIN (SELECT market, bucket, min(month) AS lo, max(last_day(month)) AS hi FROM held_n GROUP BY 1, 2) s ON s.market = g.market AND g.date BETWEEN lo AND hi""")
cte("bk_sold", "SELECT market, bucket, event_date AS date, count(DISTINCT bond_id) AS auction_bonds, round(sum(amt_bn), 3) AS auction_amount FROM iss_bucket GROUP BY 1, 2, 3")
cte("bk_rows", """
SELECT g.market, g.bucket, g.date, h.bond_id, h.maturity AS linked_maturity, h.nominal_id, h.nominal_maturity, l.settle, l.days, l.gc, l.clean AS linked_clean,
  l.V AS linked_V, l.denom AS linked_dv01, l.coupon_cash AS linked_coupon, l.fin_bp AS linked_fin_bp, l.bp AS r_linked_bp, n.clean AS nominal_clean,
  n.V AS nominal_V, n.denom AS nominal_dv01, n.coupon_cash AS nominal_coupon, n.fin_bp AS nominal_fin_bp, n.bp AS r_nominal_bp, l.bp - n.bp AS r_be_bp,
  s.auction_bonds, s.auction_amount, s.auction_bonds IS NOT NULL AS is_auction_date,
  coalesce(h.bond_id IN (SELECT e.bond_id FROM iss_bucket e WHERE e.market = g.market AND e.bucket = g.bucket AND e.event_date = g.date), false) AS auction_is_held
FROM bk_grid g LEFT JOIN held_n h ON h.market = g.market AND h.bucket = g.bucket AND h.month = date_trunc('month', g.date)
LEFT JOIN bond_rets l ON l.bond_id = h.bond_id AND l.date = g.date LEFT JOIN bond_rets n ON n.bond_id = h.nominal_id AND n.date = g.date
LEFT JOIN bk_sold s ON s.market = g.market AND s.bucket = g.bucket AND s.date = g.date""")
cte("bk_series", """
SELECT *, (nominal_maturity - linked_maturity) / 365.25 AS nominal_mat_gap_y, sum(coalesce(r_linked_bp, 0)) OVER w AS cum_linked_bp,
  sum(coalesce(r_nominal_bp, 0)) OVER w AS cum_nominal_bp, sum(coalesce(r_be_bp, 0)) OVER w AS cum_be_bp,
  (bond_id IS NOT NULL AND bond_id IS DISTINCT FROM lag(bond_id) OVER w) AS is_roll_day,
  CASE WHEN bond_id IS NOT NULL AND bond_id IS DISTINCT FROM lag(bond_id) OVER w THEN lag(bond_id) OVER w END AS held_roll_from
FROM bk_rows WINDOW w AS (PARTITION BY market, bucket ORDER BY date)""")
cte("pairs_bk", """
SELECT market, bucket, date, x_usd, linked_usd, nominal_usd, linked_usd - nominal_usd AS be_usd FROM (
  SELECT r.market, r.bucket, f.date, any_value(f.usd_per_contract) AS x_usd, sum(r_linked_bp) * 100000.0 AS linked_usd, sum(r_nominal_bp) * 100000.0 AS nominal_usd
  FROM bk_series r ASOF JOIN crude_spl f ON r.date <= f.date GROUP BY 1, 2, 3)""")
cte("pair_rets", """
WITH m AS (SELECT bond_id AS real_id, bond_id + 1 AS nominal_id, 1.0 AS beta FROM fx_static WHERE linked),
j AS (
  SELECT m.*, l.date, l.settle, l.days, l.gc, l.V AS linked_V, l.V_prev AS linked_V_prev, n.V_prev AS nominal_V_prev, l.index_ratio AS linked_ir, l.bp AS linked_bp, l.fin_bp AS linked_fin_bp, n.V AS nominal_V, n.bp AS nominal_bp,
    n.fin_bp AS nominal_fin_bp, l.is_coupon OR n.is_coupon AS is_coupon_day, l.days > 1 AS is_weekend_or_holiday_step, count(*) OVER (PARTITION BY m.real_id) AS cnt
  FROM m JOIN bond_rets l ON l.bond_id = m.real_id JOIN bond_rets n ON n.bond_id = m.nominal_id AND n.date = l.date)
SELECT *, linked_fin_bp - beta * nominal_fin_bp AS net_fin_bp, linked_bp - beta * nominal_bp AS r_be_bp, sum(linked_bp) OVER w AS cum_linked_bp,
  sum(nominal_bp) OVER w AS cum_nominal_bp, sum(linked_bp - beta * nominal_bp) OVER w AS cum_be_bp
FROM j WHERE cnt >= 2 WINDOW w AS (PARTITION BY real_id ORDER BY date)""")
