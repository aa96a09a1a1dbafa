"""Daily reference index and index ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pricing
from ..functions.daycount import month_start
from ..sources.conventions import MONTHLY_INDICES
from . import calendars

RATIO_KEYS = ["index_id", "lag_months", "interp"]


def monthly_index(series: DataFrame, index_ids=tuple(MONTHLY_INDICES)) -> DataFrame:
    """Published levels by month."""
    return series.where(F.col("series_id").isin(*index_ids) & F.col("value").isNotNull()).select(
        F.col("series_id").alias("index_id"), month_start(F.col("date")).alias("month"), F.col("value").alias("level")
    )


def daily_reference_index(days: DataFrame, series: DataFrame, on: str = "settle", out: str = "dri") -> DataFrame:
    """Lagged interpolation of the monthly index for rows with index_id, lag_months, interp and a date.

    ``a + (day - 1) / days_in_month * (b - a)`` between months M-lag and M-lag+1; step mode takes a.
    Null where a month is not published.
    """
    levels = monthly_index(series)
    low = levels.select("index_id", F.col("month").alias("__m_lo"), F.col("level").alias("__a"))
    high = levels.select("index_id", F.col("month").alias("__m_hi"), F.col("level").alias("__b"))
    month = month_start(F.col(on))
    placed = days.withColumns(
        {"__m_lo": F.add_months(month, -F.col("lag_months")), "__m_hi": F.add_months(month, 1 - F.col("lag_months"))}
    )
    met = placed.join(F.broadcast(low), ["index_id", "__m_lo"], "left").join(F.broadcast(high), ["index_id", "__m_hi"], "left")
    step = (F.dayofmonth(on) - 1) / F.dayofmonth(F.last_day(on))
    value = F.when(F.col("interp"), F.col("__a") + step * (F.col("__b") - F.col("__a"))).otherwise(F.col("__a"))
    return met.withColumn(out, value).drop("__m_lo", "__m_hi", "__a", "__b")


def index_ratio(rounding: Column, dri: Column, dri_base: Column, static_base: Column) -> Column:
    """Ratio by the market's rule: truncated against the static base, or rounded against the index's own base."""
    own = F.when(dri_base != 0, pricing.ratio_rounded(dri, dri_base))
    return F.when(rounding == "trunc", pricing.ratio_truncated(dri, static_base)).otherwise(own)


def base_reference(bonds_with_conv: DataFrame, series: DataFrame) -> DataFrame:
    """Reference index of the dated date, from the same index so that rebasing cancels."""
    return daily_reference_index(bonds_with_conv, series, on="dated", out="dri_base")


def market_days(conv: DataFrame, series: DataFrame, calendar: DataFrame) -> DataFrame:
    """(conv_id, date) to settlement date, reference index at settlement and repo rate.

    The days reach from before the first calendar and curve to their ends, so that a day outside, clipped to them, has its value.
    Conventions times days: bounded by the calendar, so it may be broadcast.
    """
    lags = conv.select("cal_id", "settle_lag").distinct()
    curves = calendars.repo_curves(series)
    ends = calendar.agg(F.min("date").alias("a"), F.max("date").alias("b")).union(curves.agg(F.min("date"), F.max("date"))).agg(F.min("a").alias("a"), F.max("b").alias("b"))
    whole = lags.withColumn("k", F.lit(1)).join(F.broadcast(ends.withColumn("k", F.lit(1))), "k")
    every = whole.select("cal_id", "settle_lag", F.explode(F.sequence(F.date_sub("a", 1), F.col("b"))).alias("date"))
    settled = calendars.settle_join(every, calendar, lags)
    keys = conv.select("conv_id", "cal_id", "settle_lag", "repo_id", *RATIO_KEYS)
    days = settled.join(F.broadcast(keys), ["cal_id", "settle_lag"])
    days = daily_reference_index(days, series)
    return calendars.rates_at(days, curves).select("conv_id", "date", "settle", "dri", "gc")


def pct_change(series: DataFrame) -> DataFrame:
    """One- and twelve-print percentage change of the monthly indices."""
    from pyspark.sql import Window

    w = Window.partitionBy("index_id").orderBy("month")
    levels = monthly_index(series)
    return levels.withColumns(
        {"mom_pct": (F.try_divide(F.col("level"), F.lag("level", 1).over(w)) - 1) * 100,
         "yoy_pct": (F.try_divide(F.col("level"), F.lag("level", 12).over(w)) - 1) * 100}
    )


def ir_crosscheck(walked: DataFrame) -> DataFrame:
    """Vendor ratio beside ours and the absolute gap."""
    return walked.withColumn("ir_gap", F.abs(F.col("index_ratio") - F.col("vendor_ir")))
