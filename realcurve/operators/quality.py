"""Invariants of the splice; each returns its violations or their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.daycount import month_start

KEY = ["leg", "tenor"]


def check_tiling(legs: DataFrame) -> DataFrame:
    """Settlement spans must tile: days equals the settle gap of consecutive rows."""
    w = Window.partitionBy(*KEY).orderBy("date")
    gap = F.datediff("settle", F.lag("settle").over(w))
    rows = legs.withColumn("gap", gap)
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"), F.sum("days").alias("days"),
                                  F.count_if(F.col("gap").isNotNull() & (F.col("days") != F.col("gap"))).alias("violations"))


def check_roll_within_bond(legs: DataFrame, quotes: DataFrame, issue_days: DataFrame) -> DataFrame:
    """On roll days the new bond has a prior mark of its own, on or after its issue day."""
    rolls = legs.where("is_roll").select(*KEY, "bond_id", "date")
    members = rolls.select("bond_id").distinct()
    days = quotes.join(F.broadcast(members), "bond_id", "left_semi").select("bond_id", "date")
    prior = days.withColumn("prior", F.lag("date").over(Window.partitionBy("bond_id").orderBy("date")))
    seen = rolls.join(prior, ["bond_id", "date"], "left").join(issue_days, "bond_id", "left")
    bad = F.col("prior").isNull() | (F.col("issue_date").isNotNull() & (F.col("prior") < F.col("issue_date")))
    return seen.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rolls"), F.count_if(bad).alias("violations"))


def month_intersect(legs: DataFrame) -> DataFrame:
    """Month-end held bonds of both legs in months where both trade."""
    last = lambda leg: F.max_by(F.when(F.col("leg") == leg, F.col("bond_id")), F.when(F.col("leg") == leg, F.col("date")))
    held = legs.groupBy("tenor", month_start(F.col("date")).alias("month")).agg(last("linked").alias("linked_id"), last("nominal").alias("nominal_id"))
    return held.where(F.col("linked_id").isNotNull() & F.col("nominal_id").isNotNull())


def check_pairing(legs: DataFrame, maturities: DataFrame, expected: DataFrame, recent_months: int = 60) -> DataFrame:
    """Maturity months of the month-end pair against the expected table; only recent misses fail."""
    held = month_intersect(legs)
    side = lambda k: maturities.select(F.col("bond_id").alias(f"{k}_id"), F.month("maturity_date").alias(f"{k}_m"))
    m = held.join(side("linked"), "linked_id").join(side("nominal"), "nominal_id").withColumn("cal", F.month("month"))
    m = m.join(F.broadcast(expected.withColumnRenamed("month", "cal")), ["tenor", "cal"])
    m = m.withColumn("last", F.max("month").over(Window.partitionBy("tenor")))
    off = (F.col("linked_m") != F.col("linked_month")) | (F.col("nominal_m") != F.col("nominal_month"))
    recent = F.col("month") > F.add_months("last", -recent_months)
    return m.groupBy("tenor").agg(F.count(F.lit(1)).alias("months"), F.count_if(off).alias("off_table"), F.count_if(off & recent).alias("failures"))


def universe_compare(seed: DataFrame, static: DataFrame) -> DataFrame:
    """Seed coupon and maturity beside the static ones; a bond without static shows nulls."""
    s = static.select("bond_id", F.col("coupon").alias("static_coupon"), F.col("maturity").alias("static_maturity"))
    return seed.select("bond_id", F.col("coupon").alias("seed_coupon"), F.col("maturity").alias("seed_maturity")).join(s, "bond_id", "left").withColumn(
        "missing", F.col("static_coupon").isNull()
    )


def feed_coverage(universe: DataFrame, feed: DataFrame) -> DataFrame:
    """How many universe ids the feed has, its first and last day for them, and the share present."""
    per_bond = feed.groupBy("bond_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    seen = universe.select("bond_id").distinct().join(per_bond, "bond_id", "left")
    return seen.agg(F.count(F.lit(1)).alias("ids"), F.count("lo").alias("present"), F.min("lo").alias("first"), F.max("hi").alias("last")).withColumn(
        "pct", F.bround(100.0 * F.col("present") / F.col("ids"), 0).cast("int")
    )
