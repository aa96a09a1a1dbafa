"""Business-day calendars and the dense per-market day dimension.

Calendars, price indices and repo curves are bounded by the number of days, not by the data, so
they are expanded once to a dense day table. The quotes then meet them with one broadcast equi-join
instead of three as-of joins over the fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.daycount import nth_weekday
from ..sources.conventions import CALENDAR_SERIES, REPO_LADDERS, inline

FORWARD_DAYS = 400  # fixed value: weekdays assumed open after the last print


def trading_calendar(series: DataFrame, calendar_series: dict[str, str] = CALENDAR_SERIES) -> DataFrame:
    """Days the calendar's series printed, then weekdays for 400 days more; ``seq`` counts from 1."""
    spark = series.sparkSession
    ids = inline(spark, ["cal_id", "series_id"], list(calendar_series.items()))
    printed = series.where(F.col("value").isNotNull()).join(F.broadcast(ids), "series_id").select("cal_id", "date").distinct()
    ends = printed.groupBy("cal_id").agg(F.max("date").alias("last"))
    ahead = ends.select(
        "cal_id", F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", FORWARD_DAYS))).alias("date")
    ).where(F.weekday("date") < 5)
    w = Window.partitionBy("cal_id").orderBy("date")
    return printed.unionByName(ahead).withColumn("seq", F.row_number().over(w))


def dense_days(calendar: DataFrame) -> DataFrame:
    """Days from the eve of each calendar's first open day to its last one, with ``next_seq``, the ordinal of the first open day after.

    Earlier days count from the first open day as its eve does; ``clipped`` moves any day into the span.
    """
    span = calendar.groupBy("cal_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.max("seq").alias("last_seq"))
    grid = span.select("cal_id", "last_seq", F.explode(F.sequence(F.date_sub("lo", 1), F.col("hi"))).alias("date"))
    passed = F.count("seq").over(Window.partitionBy("cal_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return grid.join(calendar, ["cal_id", "date"], "left").withColumn("next_seq", (passed + 1).cast("int"))


def clipped(obs: DataFrame, days: DataFrame, keys: list[str], on: str = "date", out: str = "__at") -> DataFrame:
    """``obs`` with its day moved to the nearest one that ``days`` has for the keys; rows whose keys ``days`` lacks keep their day."""
    ends = days.groupBy(*keys).agg(F.min("date").alias("__lo"), F.max("date").alias("__hi"))
    near = F.least(F.greatest(F.col(on), F.col("__lo")), F.col("__hi"))
    return obs.join(F.broadcast(ends), keys, "left").withColumn(out, F.when(F.col(on).isNotNull(), near)).drop("__lo", "__hi")


def settle_days(calendar: DataFrame, lags: DataFrame) -> DataFrame:
    """Settlement date of every day: the lag-th open day strictly after it, clipped to the last one.

    ``lags`` holds the distinct (cal_id, settle_lag) in use.
    """
    wanted = dense_days(calendar).drop("seq").join(F.broadcast(lags), "cal_id").withColumn(
        "seq", F.least(F.col("next_seq") + F.col("settle_lag") - 1, F.col("last_seq"))
    )
    open_days = calendar.select("cal_id", "seq", F.col("date").alias("settle"))
    return wanted.join(F.broadcast(open_days), ["cal_id", "seq"]).select("cal_id", "settle_lag", "date", "settle")


def settle_join(obs: DataFrame, calendar: DataFrame, lags: DataFrame) -> DataFrame:
    """Attach ``settle`` to observations carrying cal_id, settle_lag and date.

    Days before the calendar count from its first open day, later ones settle on its last; null where there is no such calendar.
    """
    keys = ["cal_id", "settle_lag"]
    days = settle_days(calendar, lags)
    looked = days.withColumnRenamed("date", "__at")
    return clipped(obs, days, keys).join(F.broadcast(looked), [*keys, "__at"], "left").drop("__at")


def first_bday_on_or_after(days: DataFrame, calendar: DataFrame, on: str, cal_id: str, out: str = "bday") -> DataFrame:
    """Next open day at or after each date; null past the end of the calendar."""
    day_map = dense_days(calendar.where(F.col("cal_id") == cal_id))
    early = day_map.groupBy("cal_id").agg(F.min("date").alias("__lo"))
    first = F.when(F.col("seq").isNotNull(), F.col("seq")).otherwise(F.col("next_seq"))
    looked = day_map.select(F.col("date").alias("__at"), first.cast("int").alias("__seq"))
    open_days = calendar.where(F.col("cal_id") == cal_id).select(F.col("seq").alias("__seq"), F.col("date").alias(out))
    placed = _from_eve(days, early, on, cal_id)
    return placed.join(F.broadcast(looked.join(open_days, "__seq").drop("__seq")), "__at", "left").drop("__at")


def _from_eve(days: DataFrame, early: DataFrame, on: str, cal_id: str) -> DataFrame:
    """``days`` with ``__at``, the day itself or the eve of the calendar's first open day if that is later."""
    eve = early.where(F.col("cal_id") == cal_id).select(F.col("cal_id").alias("__cal"), "__lo")
    placed = days.withColumn("__cal", F.lit(cal_id)).join(F.broadcast(eve), "__cal", "left")
    return placed.withColumn("__at", F.when(F.col(on).isNotNull(), F.greatest(F.col(on), F.col("__lo")))).drop("__cal", "__lo")


def next_bday(days: DataFrame, calendar: DataFrame, on: str, cal_id: str, out: str) -> DataFrame:
    """Open day strictly after each date, else the next weekday past the end."""
    cal = calendar.where(F.col("cal_id") == cal_id)
    open_days = cal.select(F.col("seq").alias("__seq"), F.col("date").alias("__d"))
    dense = dense_days(cal)
    early = dense.groupBy("cal_id").agg(F.min("date").alias("__lo"))
    looked = dense.select(F.col("date").alias("__at"), F.col("next_seq").alias("__seq")).join(open_days, "__seq").drop("__seq")
    step = F.when(F.weekday(on) == 4, 3).when(F.weekday(on) == 5, 2).otherwise(1)
    placed = _from_eve(days, early, on, cal_id).join(F.broadcast(looked), "__at", "left")
    return placed.withColumn(out, F.coalesce("__d", F.date_add(on, step))).drop("__d", "__at")


def repo_curves(series: DataFrame, ladders: dict[str, list[tuple[str, float]]] = REPO_LADDERS) -> DataFrame:
    """Financing curves: first ladder rung that printed each day (with its spread), carried forward.

    Covers the domestic coalesce of three general-collateral rates and the spliced euro curves alike.
    """
    spark = series.sparkSession
    rungs = inline(spark, ["repo_id", "rung", "series_id", "spread"],
                   [(repo, i, s, x) for repo, many in ladders.items() for i, (s, x) in enumerate(many)])
    placed = series.where(F.col("value").isNotNull()).join(F.broadcast(rungs), "series_id")
    return placed.groupBy("repo_id", "date").agg(F.min_by(F.col("value") + F.col("spread"), F.col("rung")).alias("rate"))


def dense_rates(curves: DataFrame) -> DataFrame:
    """Repo rate of every day up to the end of the calendar, carried forward; ``rates_at`` reads it without an end."""
    span = curves.groupBy("repo_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    grid = span.select("repo_id", F.explode(F.sequence(F.col("lo"), F.date_add("hi", FORWARD_DAYS))).alias("date"))
    w = Window.partitionBy("repo_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(curves, ["repo_id", "date"], "left").withColumn("gc", F.last("rate", ignorenulls=True).over(w))
    return filled.select("repo_id", "date", "gc")


def rates_at(obs: DataFrame, curves: DataFrame) -> DataFrame:
    """``obs`` (with repo_id and date) with ``gc``, the last print at or before its day; null before the first print only."""
    rates = dense_rates(curves)
    ends = rates.groupBy("repo_id").agg(F.max("date").alias("__hi"))
    placed = obs.join(F.broadcast(ends), "repo_id", "left").withColumn("__at", F.least("date", "__hi")).drop("__hi")
    return placed.join(F.broadcast(rates.withColumnRenamed("date", "__at")), ["repo_id", "__at"], "left").drop("__at")


def months_between_bounds(bounds: DataFrame, lo: str, hi: str, out: str = "month") -> DataFrame:
    """One row per calendar month from ``lo`` to ``hi``."""
    return bounds.withColumn(out, F.explode(F.expr(f"sequence(trunc({lo}, 'month'), trunc({hi}, 'month'), interval 1 month)")))


def calendar_intersect(days: DataFrame, calendar: DataFrame, cal_id: str) -> DataFrame:
    """Rows on open days of one calendar."""
    open_days = calendar.where(F.col("cal_id") == cal_id).select("date")
    return days.join(F.broadcast(open_days), "date", "left_semi")


def next_expected_auction(markets: DataFrame, as_of: Column, rules: dict[str, tuple[str, int]], due_days: int = 7) -> DataFrame:
    """First rule day at or after ``as_of`` over this month and the next two."""
    month = F.explode(F.expr("transform(sequence(0, 2), i -> add_months(trunc(as_of, 'month'), i))"))
    grid = markets.withColumn("as_of", as_of).withColumn("month", month)
    day = F.lit(None).cast("date")
    for market, (weekday, nth) in rules.items():
        day = F.when(F.col("market") == market, nth_weekday(F.col("month"), weekday, nth)).otherwise(day)
    found = grid.withColumn("day", day).where(F.col("day") >= F.col("as_of")).groupBy("market", "as_of").agg(F.min("day").alias("expected"))
    ahead = F.datediff("expected", "as_of")
    return found.select("market", "as_of", "expected", ahead.alias("days_until"), (ahead <= due_days).alias("due"))
