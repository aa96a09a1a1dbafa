"""Auction-cycle seasonality of the tenor series.

Anchors, buckets and filters work on (tenor, month, period) rows; the daily step is one join with
the month anchors (a row per month, broadcast).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.daycount import month_start
from ..functions.ordered import up_to_now
from ..functions.stats import ols_columns, quantile_columns
from . import rolls

WEEK_DAYS = 7  # fixed value: the auction week, in calendar days
WINDOW_MONTHS = {"full": None, "5y": 60, "3y": 36}  # fixed values


def monthly_anchor(auctions: DataFrame, emit_from: str) -> DataFrame:
    """Earliest real linked auction of each month; new unless that auction is a reopening."""
    real = rolls.real_auctions(auctions).where(F.col("auction_date") >= F.lit(emit_from).cast("date"))
    daily = real.groupBy("auction_date").agg(F.max_by("reopening", F.struct("issue_date", "bond_id")).alias("reopening"))
    return daily.groupBy(month_start(F.col("auction_date")).alias("month")).agg(
        F.min("auction_date").alias("auction"), F.min_by(~F.col("reopening"), "auction_date").alias("new_issue")
    )


def month_anchors(anchors: DataFrame, calendar: DataFrame, cal_id: str = "US") -> DataFrame:
    """Five trading-day anchors per auction month with the late and early clamps."""
    from .calendars import dense_days

    cal = calendar.where(F.col("cal_id") == cal_id)
    days = dense_days(cal)
    open_at = cal.select("seq", F.col("date").alias("open"))
    prior = days.select("date", F.when(F.col("seq").isNotNull(), F.col("seq")).otherwise(F.col("next_seq") - 1).cast("int").alias("seq"))
    after = days.select("date", F.least(F.when(F.col("seq").isNotNull(), F.col("seq")).otherwise(F.col("next_seq")), F.col("last_seq")).cast("int").alias("seq"))

    def look(df: DataFrame, key: Column, table: DataFrame, out: str) -> DataFrame:
        side = table.join(open_at, "seq").select(F.col("date").alias("__k"), F.col("open").alias(out))
        return df.withColumn("__k", key).join(F.broadcast(side), "__k", "left").drop("__k")

    a = look(anchors, F.date_sub("month", 1), prior, "a0")
    a = look(a, F.date_sub("auction", WEEK_DAYS), prior, "a1_raw")
    a = look(a, F.date_add("auction", WEEK_DAYS), after, "a3_raw")
    a = look(a, F.last_day("month"), prior, "a4")
    late, early = F.col("a3_raw") >= F.col("a4"), F.col("a1_raw") <= F.col("a0")
    return a.select(
        "month", "new_issue", "a0", F.when(early, F.col("a0")).otherwise(F.col("a1_raw")).alias("a1"), F.col("auction").alias("a2"),
        F.when(late, F.col("a4")).otherwise(F.col("a3_raw")).alias("a3"), "a4", (late | early).alias("clamped"),
        F.when(early, "early").when(late, "late").alias("kind"),
    )


def strict_sum(c: str) -> Column:
    """Sum that any missing value makes missing."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def seasonal_table(returns: DataFrame, anchors: DataFrame, gas: DataFrame | None = None) -> DataFrame:
    """One row per (tenor, month, period): sums of daily returns, slips and gas, days and flags.

    Empty periods are emitted with null sums; a null day makes its bucket null; missing gas is zero.
    """
    daily = returns.select("tenor", "date", "r_linked_bp", "r_nominal_bp", "s_linked", "s_nominal", month_start(F.col("date")).alias("month"))
    if gas is not None:
        daily = daily.join(F.broadcast(gas.select("date", "gas_usd")), "date", "left")
    else:
        daily = daily.withColumn("gas_usd", F.lit(0.0))
    placed = daily.join(F.broadcast(anchors), "month").withColumns(
        {
            "gas_usd": F.coalesce("gas_usd", F.lit(0.0)),
            "period": F.when(F.col("date") <= F.col("a1"), 1).when(F.col("date") <= F.col("a2"), 2).when(F.col("date") <= F.col("a3"), 3).otherwise(4),
        }
    )
    flags = ["clamped", "new_issue"]
    sums = placed.groupBy("tenor", "month", "period", *flags).agg(
        strict_sum("r_linked_bp").alias("linked_pnl"), strict_sum("r_nominal_bp").alias("nominal_pnl"),
        strict_sum("s_linked").alias("linked_slip"), strict_sum("s_nominal").alias("nominal_slip"),
        F.sum("gas_usd").alias("gas_pnl"), F.count(F.lit(1)).alias("trading_days"),
    )
    months = sums.select("tenor", "month", *flags).distinct()
    grid = months.withColumn("period", F.explode(F.array(*[F.lit(p) for p in (1, 2, 3, 4)])))
    full = grid.join(sums, ["tenor", "month", "period", *flags], "left")
    return full.withColumn("trading_days", F.coalesce("trading_days", F.lit(0)))


def seasonal_qa(anchors: DataFrame, table: DataFrame) -> DataFrame:
    """Day-of-month range, seam breaks and counts of empty first and last periods: one row."""
    w = Window.partitionBy(F.lit("months of the calendar")).orderBy("month")
    seam = anchors.withColumns({"pm": F.lag("month").over(w), "pa4": F.lag("a4").over(w)})
    broken = (F.col("pm") == F.add_months("month", -1)) & (F.col("a0") != F.col("pa4"))
    left = seam.agg(F.count(F.lit(1)).alias("months"), F.min(F.dayofmonth("a2")).alias("dom_min"), F.max(F.dayofmonth("a2")).alias("dom_max"),
                    F.count_if(broken).alias("seam_breaks"))
    empty = F.col("trading_days") == 0
    right = table.agg(F.count_if((F.col("period") == 4) & empty).alias("empty_p4"), F.count_if((F.col("period") == 1) & empty).alias("empty_p1"),
                      F.count(F.lit(1)).alias("buckets"))
    return left.withColumn("one", F.lit(1)).join(right.withColumn("one", F.lit(1)), "one").drop("one")


def seasonal_metric(table: DataFrame, metric: str = "be", beta: float = 1.0, x_linked: float = 0.0, x_nominal: float = 0.0,
                    short: bool = False, hedge: DataFrame | None = None) -> DataFrame:
    """Bucket value net of half-spread and, for the breakeven, of the energy hedge of the month."""
    slip_l, slip_n = F.coalesce("linked_slip", F.lit(0.0)) * x_linked, F.coalesce("nominal_slip", F.lit(0.0)) * x_nominal
    sign = -1.0 if short else 1.0
    if metric == "linked":
        return table.withColumn("value", sign * F.col("linked_pnl") - slip_l)
    if metric == "nominal":
        return table.withColumn("value", sign * F.col("nominal_pnl") - slip_n)
    hedged = F.lit(0.0)
    if hedge is not None:
        table = table.join(F.broadcast(hedge.select("tenor", "month", "b_linked", "b_nominal")), ["tenor", "month"], "left")
        ratio = F.col("b_linked") - beta * F.col("b_nominal")
        hedged = F.coalesce(ratio, F.lit(0.0)) * F.coalesce("gas_pnl", F.lit(0.0)) / 1e5
    raw = F.col("linked_pnl") - beta * F.col("nominal_pnl")
    return table.withColumn("value", sign * (raw - hedged) - (slip_l + beta * slip_n))


def seasonal_filters(table: DataFrame, window: str = "full", issue: str = "all", months: Sequence[int] | None = None) -> DataFrame:
    """Sample window counted back from the last month, issue type and calendar months."""
    back = WINDOW_MONTHS[window]
    if back is not None:
        last = Window.partitionBy("tenor")
        table = table.withColumn("__last", F.max("month").over(last)).where(F.col("month") >= F.add_months("__last", -(back - 1))).drop("__last")
    if issue != "all":
        table = table.where(F.col("new_issue") == (issue == "new"))
    if months is not None:
        table = table.where(F.month("month").isin(*months))
    return table


def seasonal_agg(metric: DataFrame) -> DataFrame:
    """Median, quartiles, count and clamps per (calendar month, period), with the running sum of medians."""
    kept = metric.where(F.col("value").isNotNull()).withColumn("cal_month", F.month("month"))
    stats = kept.groupBy("tenor", "cal_month", "period").agg(
        *quantile_columns(F.col("value"), {"median": 0.5, "q1": 0.25, "q3": 0.75}), F.count("value").alias("n"), F.count_if("clamped").alias("clamps")
    )
    w = Window.partitionBy("tenor").orderBy("cal_month", "period").rowsBetween(Window.unboundedPreceding, 0)
    return stats.withColumn("cum_median", F.sum("median").over(w))


def seasonal_signature(metric: DataFrame) -> DataFrame:
    """Pooled median and quartiles per period."""
    return metric.where(F.col("value").isNotNull()).groupBy("tenor", "period").agg(
        *quantile_columns(F.col("value"), {"median": 0.5, "q1": 0.25, "q3": 0.75}), F.count("value").alias("n")
    )


PERIOD_DAY = {1: 4, 2: 11, 3: 18, 4: 25}  # fixed values: day of month at which a period is placed


def seasonal_history(metric: DataFrame, periods: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """Every bucket as a dated point, with the overall median of the tenor's selection."""
    shown = metric.where(F.col("value").isNotNull() & F.col("period").isin(*periods))
    day = F.element_at(F.create_map(*[F.lit(x) for pair in PERIOD_DAY.items() for x in pair]), F.col("period"))
    points = shown.select("tenor", "period", F.date_add("month", day - 1).alias("x"), "value")
    overall = points.groupBy("tenor").agg(F.percentile("value", F.lit(0.5)).alias("overall_median"))
    return points.join(F.broadcast(overall), "tenor")


def bdom(returns: DataFrame) -> DataFrame:
    """Business day of month from the start and from the end; market holidays (no settlement step) are left out."""
    real = returns.where(F.coalesce(F.col("days"), F.lit(0)) != 0).withColumn("month", month_start(F.col("date")))
    w = Window.partitionBy("tenor", "month")
    return real.withColumns(
        {"bdom": F.row_number().over(w.orderBy("date")),
         "bdom_end": F.row_number().over(w.orderBy("date")) - F.count(F.lit(1)).over(w) - 1}
    )


def calendar_effect(days: DataFrame, value: str, from_end: bool = False) -> DataFrame:
    """Median, quartiles, mean and count by business day of month, with the running sum of medians."""
    key = "bdom_end" if from_end else "bdom"
    stats = days.where(F.col(value).isNotNull()).groupBy("tenor", F.col(key).alias("day_key")).agg(
        *quantile_columns(F.col(value), {"median": 0.5, "q1": 0.25, "q3": 0.75}), F.count(value).alias("n"), F.avg(value).alias("mean")
    )
    return stats.withColumn("cum_median", F.sum("median").over(up_to_now(["tenor"], "day_key")))


def month_periods(metric: DataFrame, prefix: str = "p") -> DataFrame:
    """Periods side by side: one row per tenor and month with any value."""
    known = metric.where(F.col("value").isNotNull())
    return known.groupBy("tenor", "month").agg(*[F.max(F.when(F.col("period") == p, F.col("value"))).alias(f"{prefix}{p}") for p in (1, 2, 3, 4)])


def period_regressions(filtered: DataFrame, unfiltered: DataFrame) -> DataFrame:
    """Within-month, next-month and month-to-month regressions.

    The next-month target ignores the filters; the month-to-month one follows the filtered order
    with missing periods as zero.
    """
    m, target = month_periods(filtered), month_periods(unfiltered, "t")
    nxt = m.join(target.select("tenor", F.add_months("month", -1).alias("month"), F.col("t1").alias("next_p1")), ["tenor", "month"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    w = Window.partitionBy("tenor").orderBy("month")
    wide = nxt.withColumn("total", zero("p1") + zero("p2") + zero("p3") + zero("p4")).withColumn("next_total", F.lead("total").over(w))
    p = lambda i: F.col(f"p{i}")
    pairs = {
        "P1>P2": (p(1), p(2)), "P2>P3": (p(2), p(3)), "P3>P4": (p(3), p(4)), "P23>P4": (p(2) + p(3), p(4)), "P12>P3": (p(1) + p(2), p(3)),
        "P12>P34": (p(1) + p(2), p(3) + p(4)), "P4>P1n": (p(4), F.col("next_p1")), "M>Mn": (F.col("total"), F.col("next_total")),
    }
    long = wide.select("tenor", F.explode(F.array(*[F.struct(F.lit(k).alias("pair"), x.alias("x"), y.alias("y")) for k, (x, y) in pairs.items()])).alias("r"))
    return long.select("tenor", "r.*").groupBy("tenor", "pair").agg(*ols_columns(F.col("x"), F.col("y")))


def slice_cumulative(metric: DataFrame, periods: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """One slice per month (sum of the chosen periods) with its running total."""
    chosen = metric.where(F.col("value").isNotNull() & F.col("period").isin(*periods))
    slices = chosen.groupBy("tenor", "month").agg(F.sum("value").alias("slice"))
    return slices.withColumn("cum", F.sum("slice").over(up_to_now(["tenor"], "month")))


def event_study(returns: DataFrame, value: str, anchors: DataFrame, width: int) -> DataFrame:
    """Cumulative path of +-width trading days around each auction that falls on a return day.

    The first return row and days outside the sample have no value; paths are rebased at day 0.
    """
    w = Window.partitionBy("tenor").orderBy("date")
    numbered = returns.select("tenor", "date", F.col(value).alias("v"), F.row_number().over(w).alias("pos"))
    at = numbered.join(F.broadcast(anchors.select(F.col("a2").alias("date"), "month", "new_issue")), "date").select("tenor", "month", "new_issue", F.col("pos").alias("at"))
    offsets = at.withColumn("offset", F.explode(F.sequence(F.lit(-width), F.lit(width)))).withColumn("pos", F.col("at") + F.col("offset"))
    seen = offsets.join(numbered.where(F.col("pos") > 1).select("tenor", "pos", "v"), ["tenor", "pos"], "left")
    path = Window.partitionBy("tenor", "month").orderBy("offset")
    run = seen.withColumn("cum", F.when(F.col("v").isNotNull(), F.sum("v").over(path.rowsBetween(Window.unboundedPreceding, 0))))
    base = F.max(F.when(F.col("offset") == 0, F.col("cum"))).over(Window.partitionBy("tenor", "month"))
    return run.withColumn("__base", base).where(F.col("__base").isNotNull()).select(
        "tenor", "month", "new_issue", "offset", (F.col("cum") - F.col("__base")).alias("path")
    )


def event_summary(paths: DataFrame) -> DataFrame:
    """Median and mean path per offset."""
    return paths.groupBy("tenor", "offset").agg(F.percentile("path", F.lit(0.5)).alias("median"), F.avg("path").alias("mean"), F.count("path").alias("n"))
