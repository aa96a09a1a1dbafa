"""Grouped statistics: least squares, quantiles and performance ratios as aggregate expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import up_to_now


def ols_columns(x: Column, y: Column, prefix: str = "") -> list[Column]:
    """Slope, intercept, r2, corr, t and n of y on x; null with fewer than 3 points or constant x."""
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    n = F.count(F.when(both, F.lit(1)))
    sxx, syy, sxy = F.regr_sxx(ys, xs), F.regr_syy(ys, xs), F.regr_sxy(ys, xs)
    usable = (n >= 3) & (sxx > 0)
    slope = F.try_divide(sxy, sxx)
    noise = F.greatest(F.try_divide(syy - sxy * slope, n - 2), F.lit(0.0))
    se = F.sqrt(F.try_divide(noise, sxx))
    r = F.try_divide(sxy, F.sqrt(sxx * syy))
    return [
        F.when(usable, slope).alias(prefix + "slope"),
        F.when(usable, F.regr_avgy(ys, xs) - slope * F.regr_avgx(ys, xs)).alias(prefix + "intercept"),
        F.when(usable & (syy > 0), r * r).alias(prefix + "r2"),
        F.when(usable & (syy > 0), r).alias(prefix + "corr"),
        F.when(usable & (se > 0), F.try_divide(slope, se)).alias(prefix + "tstat"),
        n.alias(prefix + "n"),
    ]


def moment_columns(n: str, sxx: str, syy: str, sxy: str) -> dict[str, Column]:
    """Slope, r2, corr, t and n from a count and centred products, with the rules of ``ols_columns``."""
    c, xx, yy, xy = (F.col(k) for k in (n, sxx, syy, sxy))
    usable = (c >= 3) & (xx > 0)
    slope, r = F.try_divide(xy, xx), F.try_divide(xy, F.sqrt(xx * yy))
    se = F.sqrt(F.try_divide(F.greatest(F.try_divide(yy - xy * slope, c - 2), F.lit(0.0)), xx))
    seen = usable & (yy > 0)
    return {"slope": F.when(usable, slope), "r2": F.when(seen, r * r), "corr": F.when(seen, r),
            "tstat": F.when(seen & (se > 0), F.try_divide(slope, se)), "n": c.cast("long")}


def ols(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """One regression per group."""
    return df.groupBy(*by).agg(*ols_columns(F.col(x), F.col(y)))


def quantile_columns(value: Column, points: dict[str, float]) -> list[Column]:
    """Exact linear-interpolated quantiles, nulls ignored."""
    return [F.percentile(value, F.lit(p)).alias(name) for name, p in points.items()]


def quantile_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, median, quartiles, 10/90 whiskers and extremes."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"),
        *quantile_columns(v, {"median": 0.5, "q1": 0.25, "q3": 0.75, "p10": 0.1, "p90": 0.9}),
        F.min(v).alias("lo"), F.max(v).alias("hi"),
    )


def robust_range(df: DataFrame, by: Sequence[str], value: str, pad: float = 0.10) -> DataFrame:
    """p1..p99 of the pooled values widened by a share of the span (1 if the span is zero)."""
    spread = F.col("p99") - F.col("p01")
    margin = F.when(spread * pad == 0, F.lit(1.0)).otherwise(spread * pad)
    pooled = df.groupBy(*by).agg(F.count(value).alias("n"), *quantile_columns(F.col(value), {"p01": 0.01, "p99": 0.99}))
    return pooled.select(
        *by, "n",
        F.when(F.col("n") >= 3, F.col("p01") - margin).alias("lo"),
        F.when(F.col("n") >= 3, F.col("p99") + margin).alias("hi"),
    )


def perf_metrics_slice(df: DataFrame, by: Sequence[str], month: str, value: str) -> DataFrame:
    """Count, total, mean, volatility, annualised Sharpe and drawdown of one slice per month."""
    run = df.where(F.col(value).isNotNull()).withColumn("cum", F.sum(value).over(up_to_now(by, month)))
    run = run.withColumn("dd", F.max("cum").over(up_to_now(by, month)) - F.col("cum"))
    flat = run.groupBy(*by).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("vol"), F.max("dd").alias("max_drawdown"),
        F.max(month).alias("last"), F.min(month).alias("first"),
    )
    months = (F.year("last") - F.year("first")) * 12 + F.month("last") - F.month("first")
    years = F.when(F.col("n") > 1, months / 12.0).otherwise(F.lit(1.0))
    per_year = F.when(years > 0, F.col("n") / years).otherwise(F.lit(12.0))
    sharpe = F.when(F.col("vol") > 0, F.col("mean") / F.col("vol") * F.sqrt(per_year)).otherwise(F.lit(0.0))
    return flat.select(*by, "n", "total", "mean", "vol", sharpe.alias("sharpe"), "max_drawdown")


def perf_metrics_weekly(df: DataFrame, by: Sequence[str], week: str, level: str) -> DataFrame:
    """Annualised return and volatility, Sharpe, drawdown and hit rate of a weekly level; 4 points needed."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(week)
    kept = df.where(F.col(level).isNotNull())
    moves = kept.withColumns(
        {"move": F.col(level) - F.lag(level).over(w), "under": F.col(level) - F.max(level).over(up_to_now(by, week))}
    )
    agg = moves.groupBy(*by).agg(
        F.count(level).alias("points"), (F.avg("move") * 52).alias("ann_ret"),
        (F.stddev_samp("move") * F.sqrt(F.lit(52.0))).alias("ann_vol"), F.min("under").alias("max_dd"),
        (F.try_divide(F.count_if(F.col("move") > 0), F.count("move")) * 100).alias("hit_pct"),
    )
    return agg.where(F.col("points") >= 4).select(
        *by, "points", "ann_ret", "ann_vol",
        F.when(F.col("ann_vol") > 0, F.col("ann_ret") / F.col("ann_vol")).alias("sharpe"), "max_dd", "hit_pct",
    )


def path_corr(df: DataFrame, by: Sequence[str], month: str, a: str, b: str) -> DataFrame:
    """Correlation of two monthly paths on common months (more than two) and their last-value ratio."""
    agg = df.groupBy(*by).agg(
        F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.lit(1))).alias("months"),
        F.corr(a, b).alias("corr"),
        F.max_by(F.col(a), F.when(F.col(a).isNotNull(), F.col(month))).alias("last_a"),
        F.max_by(F.col(b), F.when(F.col(b).isNotNull(), F.col(month))).alias("last_b"),
    )
    return agg.select(*by, "months", "last_a", "last_b", F.try_divide("last_b", "last_a").alias("ratio"),
                      F.when(F.col("months") > 2, F.col("corr")).alias("corr"))
