"""Event studies and calendar statistics of the bucket series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.daycount import month_start
from ..functions.ordered import asof
from ..functions.stats import ols_columns, quantile_stats
from ..sources.conventions import CYCLE_MARKETS

KEYS = ["market", "bucket"]
MIN_TAPS = 3
MIN_MONTH_DAYS = 10
HALF_WIDTH = 21  # fixed value: trading days each side


def crude_level(crude: DataFrame) -> DataFrame:
    """Running dollars per contract of the energy series."""
    w = Window.partitionBy(F.lit("one futures series")).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return crude.select("date", F.sum("usd_per_contract").over(w).alias("crude_cum"))


def event_study_bucket(series: DataFrame, width: int = HALF_WIDTH, crude: DataFrame | None = None) -> DataFrame:
    """Rebased cumulative paths around every in-bucket sale (three or more of them).

    A day in range without a return counts zero; days out of range have no value. The energy path is
    the running contract level as of each day, rebased at the sale.
    """
    w = Window.partitionBy(*KEYS).orderBy("date")
    days = series.where(F.col("market").isin(*CYCLE_MARKETS)).select(*KEYS, "date", "r_linked_bp", "r_be_bp", "is_auction_date")
    if crude is not None:
        days = _crude_asof(days, crude_level(crude).withColumn("k", F.lit(1)))
    else:
        days = days.withColumn("crude_cum", F.lit(None).cast("double"))
    everything = Window.partitionBy(*KEYS)
    days = days.withColumns(
        {
            "pos": F.row_number().over(w), "taps": F.count_if("is_auction_date").over(everything),
            "be_days": F.count("r_be_bp").over(everything), "out_days": F.count("r_linked_bp").over(everything),
        }
    ).where((F.col("taps") >= MIN_TAPS) & (F.col("out_days") > 0))
    taps = days.where("is_auction_date").select(*KEYS, F.col("date").alias("tap_date"), F.col("pos").alias("at"))
    offsets = taps.withColumn("offset", F.explode(F.sequence(F.lit(-width), F.lit(width)))).withColumn("pos", F.col("at") + F.col("offset"))
    seen = offsets.join(days.select(*KEYS, "pos", "r_linked_bp", "r_be_bp", "be_days", "crude_cum"), [*KEYS, "pos"], "left")
    inside = F.col("be_days").isNotNull()
    one = Window.partitionBy(*KEYS, "tap_date")
    run = one.orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    seen = seen.withColumns({"__out": F.sum(zero("r_linked_bp")).over(run), "__be": F.sum(zero("r_be_bp")).over(run)})
    at0 = lambda c: F.max(F.when(F.col("offset") == 0, F.col(c))).over(one)
    has_be = F.max("be_days").over(one) > 0
    return seen.select(
        *KEYS, "tap_date", "offset",
        F.when(inside, F.col("__out") - at0("__out")).alias("out_path"),
        F.when(inside & has_be, F.col("__be") - at0("__be")).alias("be_path"),
        F.when(inside, F.col("crude_cum") - at0("crude_cum")).alias("crude_path"),
    )


def _crude_asof(days: DataFrame, level: DataFrame) -> DataFrame:
    """Contract level as of each distinct day, joined back (days are few; bucket rows are not windowed)."""
    distinct = days.select("date").distinct().withColumn("k", F.lit(1))
    known = asof(distinct, level, ["k"], "date", ["crude_cum"]).drop("k")
    return days.join(F.broadcast(known), "date", "left")


def cycle_values(paths: DataFrame, metric: str = "be", beta: float = 1.0, since: str | None = None, hedge: DataFrame | None = None) -> DataFrame:
    """Path value at a beta, optionally net of the energy hedge, for taps since a date."""
    if since is not None:
        paths = paths.where(F.col("tap_date") >= F.lit(since).cast("date"))
    out, be = F.col("out_path"), F.col("be_path")
    value = out if metric == "out" else out - beta * (out - be)
    if hedge is not None:
        paths = paths.join(F.broadcast(hedge.select(*KEYS, "b_linked", "b_nominal")), KEYS, "left")
        ratio = F.col("b_linked") if metric == "out" else F.col("b_linked") - beta * F.col("b_nominal")
        value = value - F.coalesce(ratio * F.col("crude_path") / 1e5, F.lit(0.0))
    return paths.withColumn("value", value)


def cycle_distribution(values: DataFrame) -> DataFrame:
    """Cross-event statistics per offset."""
    return quantile_stats(values.where(F.col("value").isNotNull()), [*KEYS, "offset"], "value")


def cycle_period_regressions(values: DataFrame) -> DataFrame:
    """Four five-day periods per tap and the regression of each on the one before."""
    need = [-10, -5, 0, 5, 10]
    wide = values.where(F.col("offset").isin(*need)).groupBy(*KEYS, "tap_date").agg(
        *[F.max(F.when(F.col("offset") == k, F.col("value"))).alias(f"v{i}") for i, k in enumerate(need)]
    ).dropna(subset=[f"v{i}" for i in range(5)])
    p = [F.col(f"v{i + 1}") - F.col(f"v{i}") for i in range(4)]
    pairs = F.explode(F.array(*[F.struct(F.lit(f"P{i + 1}>P{i + 2}").alias("pair"), p[i].alias("x"), p[i + 1].alias("y")) for i in range(3)]))
    return wide.select(*KEYS, pairs.alias("r")).select(*KEYS, "r.*").groupBy(*KEYS, "pair").agg(*ols_columns(F.col("x"), F.col("y")))


def monthly_sum_min10(series: DataFrame, cols: tuple[str, ...] = ("r_linked_bp", "r_be_bp")) -> DataFrame:
    """Monthly sums over a gap-free month range; null with fewer than ten known days."""
    sums = series.groupBy(*KEYS, month_start(F.col("date")).alias("month")).agg(
        *[F.when(F.count(c) >= MIN_MONTH_DAYS, F.sum(c)).alias(c) for c in cols]
    )
    span = sums.groupBy(*KEYS).agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    grid = span.select(*KEYS, F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month"))
    return grid.join(sums, [*KEYS, "month"], "left")


def calendar_month(monthly: DataFrame, metric: str = "be", beta: float = 1.0, since: str | None = None,
                   hedge: DataFrame | None = None, crude: DataFrame | None = None) -> DataFrame:
    """Statistics by calendar month across years; optionally net of the energy hedge."""
    if since is not None:
        monthly = monthly.where(F.col("month") >= month_start(F.lit(since).cast("date")))
    out, be = F.col("r_linked_bp"), F.col("r_be_bp")
    value = out if metric == "out" else out - beta * (out - be)
    if hedge is not None and crude is not None:
        monthly = monthly.join(F.broadcast(hedge.select(*KEYS, "b_linked", "b_nominal")), KEYS, "left").join(F.broadcast(crude), "month", "left")
        ratio = F.col("b_linked") if metric == "out" else F.col("b_linked") - beta * F.col("b_nominal")
        value = value - F.coalesce(ratio * F.col("crude_usd") / 1e5, F.lit(0.0))
    kept = monthly.withColumn("value", value).where(F.col("value").isNotNull()).withColumn("cal_month", F.month("month"))
    stats = quantile_stats(kept, [*KEYS, "cal_month"], "value")
    years = kept.select(*KEYS, F.year("month").alias("y")).distinct().groupBy(*KEYS).agg(F.count(F.lit(1)).alias("years"))
    return stats.join(years, KEYS)
