"""Bond mathematics as column expressions: accrued, dirty price, DV01, index ratio rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import daycount as dc

BUMP_BP = 1.0  # fixed value: symmetric bump width


def annuity_price(periodic_yield: Column, w: Column, n: Column, coupon: Column) -> Column:
    """Dirty price per 100: n coupons at exponents w, w+1, ... plus redemption with the last one.

    Closed geometric sum in log form, exact near a zero yield too: no array and no loop.
    """
    growth = F.lit(1.0) + periodic_yield
    rate = F.log1p(periodic_yield)
    strip = F.coalesce(F.try_divide(-F.expm1(-rate * n) * growth, periodic_yield), n.cast("double"))
    return F.exp(-rate * w) * (coupon * strip + F.lit(100.0) * F.exp(-rate * (n - 1)))


def dirty_price(ytm_pct: Column, w: Column, n: Column, coupon: Column, freq: Column) -> Column:
    return annuity_price(ytm_pct / 100.0 / freq, w, n, coupon / freq)


def dv01(ytm_pct: Column, w: Column, n: Column, coupon: Column, freq: Column, ratio: Column | float = 1.0) -> Column:
    """Cash value of one basis point per 100 face; the clean quote is held, only discounting moves."""
    half = BUMP_BP / 2.0 / 100.0
    down = dirty_price(ytm_pct - half, w, n, coupon, freq)
    up = dirty_price(ytm_pct + half, w, n, coupon, freq)
    return (down - up) / BUMP_BP * ratio


def ratio_truncated(reference: Column, base: Column) -> Column:
    """Truncate to 6 decimals, then half-up to 5, in whole millionths so no binary tie decides."""
    millionths = F.floor(F.try_divide(reference, base) * 1e6)
    return F.floor((millionths + 5) / 10).cast("double") / 1e5


def ratio_rounded(reference: Column, base: Column) -> Column:
    """Half-even to 5 decimals on the scaled double."""
    return F.rint(F.try_divide(reference, base) * 1e5) / 1e5


def with_coupon_position(df: DataFrame) -> DataFrame:
    """Add ``n_left``, ``prev_anchor``, ``next_coupon`` and ``w`` at ``settle``.

    The first accrual period starts at the dated date. Rows outside [dated, maturity) go.
    """
    inside = df.where((F.col("dated") <= F.col("settle")) & (F.col("settle") < F.col("maturity")))
    counted = inside.withColumn("n_left", dc.coupons_after(F.col("settle"), F.col("maturity"), F.col("freq")))
    placed = counted.withColumns(
        {
            "next_coupon": dc.coupon_back(F.col("maturity"), F.col("freq"), F.col("n_left") - 1),
            "prev_anchor": F.greatest(
                F.col("dated"), dc.coupon_back(F.col("maturity"), F.col("freq"), F.col("n_left"))
            ),
        }
    )
    period = F.datediff("next_coupon", "prev_anchor")
    return placed.withColumn("w", F.datediff("next_coupon", "settle") / period)


def accrued(coupon: Column, freq: Column, w: Column) -> Column:
    return coupon / freq * (F.lit(1.0) - w)


def bond_metrics(df: DataFrame) -> DataFrame:
    """Value every quote at its settlement date.

    Needs ``settle, clean, ytm, coupon, freq, dated, maturity, index_ratio``; adds ``accrued,
    dirty_real, V, dv01`` and the coupon position. A missing index ratio leaves V and dv01 null.
    """
    c, f = F.col("coupon"), F.col("freq")
    return (
        with_coupon_position(df)
        .withColumn("accrued", accrued(c, f, F.col("w")))
        .withColumn("dirty_real", F.col("clean") + F.col("accrued"))
        .withColumn("V", F.col("dirty_real") * F.col("index_ratio"))
        .withColumn("dv01", dv01(F.col("ytm"), F.col("w"), F.col("n_left"), c, f, F.col("index_ratio")))
    )
