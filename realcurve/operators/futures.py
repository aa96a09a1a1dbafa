"""Front-month futures spliced across contract rolls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.daycount import month_start
from . import calendars

GASOLINE_MULTIPLIER = 420.0  # fixed values: dollars per price point of one contract
CRUDE_MULTIPLIER = 1000.0
ONE_SERIES = "one futures series, a row a day"


def _lagged(days: DataFrame) -> DataFrame:
    w = Window.partitionBy(F.lit(ONE_SERIES)).orderBy("date")
    return days.withColumns(
        {"prev_date": F.lag("date").over(w), "prev_front": F.lag("front").over(w), "prev_second": F.lag("second").over(w),
         "prev_front_gen": F.lag("front_gen").over(w), "prev_second_gen": F.lag("second_gen").over(w)}
    )


def _priced(rows: DataFrame, multiplier: float, emit_from: str | None) -> DataFrame:
    out = rows.where(F.col("prior_mark").isNotNull() & (F.col("prior_mark") != 0) & F.col("front").isNotNull())
    chg = F.col("front") - F.col("prior_mark")
    out = out.select("date", "front", "second", "prior_mark", F.datediff("date", "prev_date").alias("days"), "is_roll", chg.alias("chg"),
                     (chg * multiplier).alias("usd_per_contract"), (F.try_divide(chg, F.col("prior_mark")) * 1e4).alias("r_bp"))
    if emit_from is not None:
        out = out.where(F.col("date") >= F.lit(emit_from).cast("date"))
    w = Window.partitionBy(F.lit(ONE_SERIES)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("cum_bp", F.sum("r_bp").over(w))


def common_days(futures: DataFrame, calendar: DataFrame, cal_id: str = "US") -> DataFrame:
    """Futures days that are also business days of the bond calendar."""
    return calendars.calendar_intersect(futures.where(F.col("front").isNotNull()), calendar, cal_id)


def futures_splice_month(futures: DataFrame, calendar: DataFrame, multiplier: float = GASOLINE_MULTIPLIER, emit_from: str | None = None) -> DataFrame:
    """The front rolls on the first common day of a month; its prior mark is then yesterday's second.

    A roll without a second is skipped, but that day is still the next day's previous one.
    """
    days = _lagged(common_days(futures, calendar)).where(F.col("prev_date").isNotNull())
    rolled = days.withColumn("is_roll", month_start(F.col("date")) != month_start(F.col("prev_date")))
    return _priced(rolled.withColumn("prior_mark", F.when(F.col("is_roll"), F.col("prev_second")).otherwise(F.col("prev_front"))), multiplier, emit_from)


def futures_splice_ticker(futures: DataFrame, calendar: DataFrame, multiplier: float = CRUDE_MULTIPLIER, emit_from: str | None = None) -> DataFrame:
    """The front rolls when its contract changes; valid only if yesterday's second was the new front (or unknown)."""
    days = _lagged(common_days(futures, calendar)).where(F.col("prev_date").isNotNull())
    rolled = days.withColumn("is_roll", F.coalesce(F.col("front_gen") != F.col("prev_front_gen"), F.lit(False)))
    valid = F.col("prev_second_gen").isNull() | (F.col("prev_second_gen") == F.col("front_gen"))
    mark = F.when(F.col("is_roll"), F.when(valid, F.col("prev_second"))).otherwise(F.col("prev_front"))
    return _priced(rolled.withColumn("prior_mark", mark), multiplier, emit_from)


def naive_vs_spliced(futures: DataFrame, spliced: DataFrame) -> DataFrame:
    """On roll days: the front-only return (across contracts) beside the spliced one."""
    w = Window.partitionBy(F.lit(ONE_SERIES)).orderBy("date")
    front = futures.where(F.col("front").isNotNull()).select("date", "front", F.lag("front").over(w).alias("before"))
    naive = front.select("date", (F.try_divide(F.col("front") - F.col("before"), F.col("before")) * 1e4).alias("naive_r_bp"))
    return spliced.where("is_roll").join(naive, "date", "left").select("date", "days", "r_bp", "naive_r_bp")


def crude_monthly(spliced: DataFrame) -> DataFrame:
    return spliced.groupBy(month_start(F.col("date")).alias("month")).agg(F.sum("usd_per_contract").alias("crude_usd"))
