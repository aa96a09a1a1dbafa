"""Repo financing and half-spread arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_HALF_SPREAD_BP = 3.0  # fixed value


def leg_financing(v_prev: Column, days: Column, rate_pct: Column, side: Column, x_bp: float = DEFAULT_HALF_SPREAD_BP) -> Column:
    """Signed financing cash of one leg: a long pays rate + x, a short earns rate - x (act/360)."""
    pays = -v_prev * ((rate_pct + x_bp / 100.0) / 100.0) * (days / 360.0)
    earns = v_prev * ((rate_pct - x_bp / 100.0) / 100.0) * (days / 360.0)
    bad = F.raise_error(F.concat(F.lit("side must be long or short, got "), side)).cast("double")
    return F.when(side == "long", pays).when(side == "short", earns).otherwise(bad)


def package_financing(v_linked: Column, v_nominal: Column, days: Column, rate_pct: Column, direction: Column,
                      x_bp: float = DEFAULT_HALF_SPREAD_BP) -> Column:
    """Both legs of a breakeven: ``long_be`` is long linked and short nominal, ``short_be`` the reverse."""
    linked_side = F.when(direction == "long_be", F.lit("long")).when(direction == "short_be", F.lit("short")).otherwise(direction)
    nominal_side = F.when(direction == "long_be", F.lit("short")).when(direction == "short_be", F.lit("long")).otherwise(direction)
    return leg_financing(v_linked, days, rate_pct, linked_side, x_bp) + leg_financing(v_nominal, days, rate_pct, nominal_side, x_bp)


def half_spread(returns: DataFrame, x_linked: float = 0.0, x_nominal: float = 0.0) -> DataFrame:
    """Long and short breakeven after the repo half-spread; both directions pay it."""
    slip = F.lit(x_linked) * F.col("s_linked") + F.lit(x_nominal) * F.col("s_nominal")
    return returns.withColumns(
        {"long_be_bp": F.col("r_be_bp") - slip, "short_be_bp": -F.col("r_be_bp") - slip}
    )


def beta_breakeven(returns: DataFrame, beta: float, x_linked: float = 0.0, x_nominal: float = 0.0,
                   b_linked: str = "b_linked", b_nominal: str = "b_nominal", gas: str = "gas_usd") -> DataFrame:
    """Breakeven with the nominal leg weighted by beta, net of half-spread and energy hedge.

    The hedge ratio is linear in beta, so the two leg slopes serve every beta. Days without a
    ratio are unhedged.
    """
    be = F.col("r_linked_bp") - beta * F.col("r_nominal_bp")
    slip = x_linked * F.col("s_linked") + beta * x_nominal * F.col("s_nominal")
    ratio = F.col(b_linked) - beta * F.col(b_nominal)
    hedge = F.coalesce(ratio, F.lit(0.0)) * F.coalesce(F.col(gas), F.lit(0.0)) / 1e5
    return returns.withColumns({"mid_bp": be - hedge, "long_bp": be - slip - hedge, "short_bp": -be - slip + hedge})
