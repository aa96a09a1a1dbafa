"""Breakeven pairs: a linked bond against its mapped nominal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import up_to_now

LEG_FIELDS = ["clean", "ytm", "accrued", "index_ratio", "dirty_real", "V", "V_prev", "notional", "denom", "dV",
              "coupon_cash", "financing", "gross_bp", "fin_bp", "bp", "is_coupon"]
BREAKEVEN_FIELDS = ["fin_bp", "bp", "is_coupon"]  # what the breakeven needs of a leg


def scan_pair_map(pair_map: DataFrame) -> DataFrame:
    """Rows naming both bonds; a missing or unreadable beta is one."""
    return pair_map.where(F.col("real_id").isNotNull() & F.col("nominal_id").isNotNull()).withColumn(
        "beta", F.coalesce(F.col("beta").try_cast("double"), F.lit(1.0))
    )


def mapped_bonds(pair_map: DataFrame) -> DataFrame:
    """Every bond that a pair names; joined to the raw scan so that nothing else is priced."""
    return pair_map.select(F.col("real_id").alias("bond_id")).union(pair_map.select("nominal_id")).where(F.col("bond_id").isNotNull()).distinct()


def pair_inner(returns: DataFrame, pair_map: DataFrame, fields: Sequence[str] = LEG_FIELDS) -> DataFrame:
    """Both legs of each pair on common days, with ``fields`` of each leg; pairs with fewer than two such days go. A pair that the map names twice is one.

    ``returns`` is read once: a row fans out to the pairs of its bond with its role, and the two roles of a pair's day meet in one aggregate.
    Its key holds pair and day, so one nominal that hedges many linkers spreads out.
    """
    pair = F.struct("real_id", "nominal_id", "beta")
    role = lambda c, name: pair_map.select(F.col(c).alias("bond_id"), F.struct(pair.alias("pair"), F.lit(name).alias("role")).alias("r"))
    roles = role("real_id", "linked").union(role("nominal_id", "nominal")).groupBy("bond_id").agg(F.collect_set("r").alias("roles"))  # pairs of a bond
    base = returns.select("bond_id", "date", F.struct("settle", "days", "gc", *fields).alias("v"))
    fanned = base.join(roles, "bond_id").select("date", "v", F.explode("roles").alias("r"))
    leg = lambda name: F.first(F.when(F.col("r.role") == name, F.col("v")), ignorenulls=True).alias(name)  # noqa: E731  a bond has one row a day
    met = fanned.groupBy(F.col("r.pair").alias("pair"), "date").agg(leg("linked"), leg("nominal")).where(F.col("linked").isNotNull() & F.col("nominal").isNotNull())
    both = met.select("pair.*", "date", *[F.col(f"linked.{c}") for c in ("settle", "days", "gc")], *[F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in ("linked", "nominal") for c in fields])
    counted = both.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("real_id")))
    return counted.where(F.col("__n") >= 2).drop("__n")


def pair_breakeven(returns: DataFrame, pair_map: DataFrame, fields: Sequence[str] = LEG_FIELDS) -> DataFrame:
    """Both legs' chain side by side, the breakeven return and its running sums over joined days."""
    both = pair_inner(returns, scan_pair_map(pair_map), fields).withColumns(
        {
            "net_fin_bp": F.col("linked_fin_bp") - F.col("beta") * F.col("nominal_fin_bp"),
            "r_be_bp": F.col("linked_bp") - F.col("beta") * F.col("nominal_bp"),
            "is_coupon_day": F.col("linked_is_coupon") | F.col("nominal_is_coupon"),
            "is_weekend_or_holiday_step": F.col("days") > 1,
        }
    )
    w = up_to_now(["real_id"], "date")
    return both.withColumns(
        {"cum_linked_bp": F.sum("linked_bp").over(w), "cum_nominal_bp": F.sum("nominal_bp").over(w), "cum_be_bp": F.sum("r_be_bp").over(w)}
    )


def longest_history_pair(pairs: DataFrame) -> DataFrame:
    """The pair with most days (smallest id among equals)."""
    sizes = pairs.groupBy("real_id", "nominal_id").agg(F.count(F.lit(1)).alias("days"))
    return sizes.agg(F.max_by(F.struct("real_id", "nominal_id", "days"), F.struct(F.col("days"), -F.col("real_id"))).alias("p")).select("p.*")
