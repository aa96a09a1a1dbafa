"""Reading landed tables and the light normalization each one needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import conventions as cv


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing floats arrive as NaN; one null policy from here on."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in floats})


def scan_quotes(quotes: DataFrame) -> DataFrame:
    """Quotes with price and yield; bonds with fewer than two of them are skipped."""
    known = quotes.dropna(subset=["clean", "ytm"])
    n = F.count(F.lit(1)).over(Window.partitionBy("bond_id"))
    return known.withColumn("__n", n).where(F.col("__n") >= 2).drop("__n")


def raw_static(bonds: DataFrame) -> DataFrame:
    """Static as landed: the three accrual-start candidates may each be missing."""
    k = F.col("bond_id")
    isin = F.concat("country", F.lpad(k.cast("string"), 10, "0"))
    return bonds.select(
        "bond_id", isin.alias("isin"), "coupon", "maturity", F.when(k % 3 == 0, F.col("dated")).alias("accrual_date"),
        F.when(k % 3 == 1, F.col("dated")).alias("issue_date"), F.col("dated").alias("first_settle"),
        F.when(k % 2 == 0, F.concat(F.lower("country"), F.lit(" region"))).when(k % 4 == 1, F.lit("??")).alias("static_country"),
    )


def scan_static(raw: DataFrame) -> DataFrame:
    """Coupon, maturity and the first known of accrual, issue and first-settle dates."""
    return raw.select("bond_id", "coupon", "maturity", F.coalesce("accrual_date", "issue_date", "first_settle").alias("accrual_start"))


def dated_date(bonds: DataFrame, auctions: DataFrame) -> DataFrame:
    """Accrual start from the first auction row, else the static issue date."""
    first = auctions.groupBy("bond_id").agg(F.min_by("dated_date", F.struct("auction_date", "dated_date")).alias("__d"))
    return bonds.join(first, "bond_id", "left").select("bond_id", F.coalesce("__d", "issue").alias("dated"))


def active(bonds: DataFrame, idle: DataFrame) -> DataFrame:
    """Bonds that trade: no deferred structure and not in ``idle`` (bond_id), the list of private placements."""
    return bonds.where(~F.col("deferred")).join(idle.select("bond_id"), "bond_id", "left_anti")


def build_universe(bonds: DataFrame, conv: DataFrame, idle: DataFrame) -> DataFrame:
    """Linkers with their conventions; deferred structures and lines in ``idle`` (bond_id), which never trade, are flagged."""
    rules = conv.select(F.col("conv_id").alias("market"), "country", "program", "index_id", "freq", F.col("deferred").alias("__def"))
    seed = bonds.where("linked").select("bond_id", "market", "coupon", "maturity", F.col("issue").alias("first_issue"))
    listed = seed.join(F.broadcast(rules), "market").join(idle.select("bond_id", F.lit(True).alias("__idle")).distinct(), "bond_id", "left")
    return listed.withColumn("deferred", F.col("__def") | F.coalesce("__idle", F.lit(False))).drop("__def", "__idle")


def scan_universe(universe: DataFrame, include_deferred: bool = False) -> DataFrame:
    return universe if include_deferred else universe.where(~F.col("deferred"))


def universe_counts(universe: DataFrame, by: Sequence[str]) -> DataFrame:
    return universe.groupBy(*by).agg(F.count(F.lit(1)).alias("bonds"))


def market_matrix(bonds: DataFrame) -> DataFrame:
    """Linked-market conventions with the number of bonds each one governs."""
    sizes = bonds.where("linked").groupBy("market").agg(F.count(F.lit(1)).alias("bonds"))
    return cv.market_matrix(bonds.sparkSession).join(sizes, "market", "left").withColumn("bonds", F.coalesce("bonds", F.lit(0)))


def issuer_country(static: DataFrame, known: Sequence[str] = tuple(cv.COUNTRIES)) -> DataFrame:
    """Static country when its first two letters are known, else the ISIN prefix when that is."""
    two = lambda c: F.upper(F.substring(F.trim(F.col(c)), 1, 2))
    known_of = lambda c: F.when(two(c).isin(*known), two(c))
    return static.select("bond_id", F.coalesce(known_of("static_country"), known_of("isin")).alias("issuer"))


def padded_quotes(quotes: DataFrame) -> DataFrame:
    """Quotes as a vendor pads them: early rows carry no price."""
    keep = (F.col("date") >= F.lit("1996-01-01").cast("date")) | (F.col("bond_id") % 3 == 0)
    return quotes.withColumn("clean", F.when(keep, F.col("clean")))


def trim_leading_nulls(quotes: DataFrame, price: str) -> DataFrame:
    """Drop each bond's rows before its first known price."""
    first = F.min(F.when(F.col(price).isNotNull(), F.col("date"))).over(Window.partitionBy("bond_id"))
    return quotes.withColumn("__first", first).where(F.col("date") >= F.col("__first")).drop("__first")


def macro_outer_join(series: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Chosen series side by side on the union of their dates; the columns are stated, not discovered."""
    return series.where(F.col("series_id").isin(*ids)).groupBy("date").pivot("series_id", list(ids)).agg(F.first("value"))


def month_end(df: DataFrame, on: str = "date") -> DataFrame:
    """Snap monthly prints to month-end."""
    return df.withColumn(on, F.last_day(on))


def asof_rate(obs: DataFrame, curves: DataFrame) -> DataFrame:
    """Last known repo rate at or before each observation.

    Curves are bounded by days, so they are made dense and broadcast: the fact is never windowed and
    a curve that serves most bonds is no hot key.
    """
    from ..operators.calendars import rates_at

    return rates_at(obs, curves)


def settle_grid(calendar: DataFrame, conv: DataFrame) -> DataFrame:
    """Open days of each calendar for the index rules that settle on it."""
    rules = conv.where(F.col("index_id").isNotNull()).select("cal_id", "index_id", "lag_months", "interp").distinct()
    return calendar.select("cal_id", F.col("date").alias("settle")).join(F.broadcast(rules), "cal_id")


def partial_static(bonds: DataFrame) -> DataFrame:
    """Confirmed static of most bonds, some with another coupon."""
    k = F.col("bond_id")
    return bonds.where(k % 6 != 1).select("bond_id", (F.col("coupon") + F.when(k % 4 == 0, 0.125).otherwise(0.0)).alias("coupon"), "maturity")


def revision_split(quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cached, fetched): the fetch revises even bonds from June 1999 on and adds their last stretch."""
    cut = F.lit("2000-06-01").cast("date")
    old = quotes.where(F.col("date") < cut)
    even = quotes.where((F.col("bond_id") % 2 == 0) & (F.col("date") >= F.lit("1999-06-01").cast("date")))
    return old, even.select("bond_id", "date", (F.col("clean") + 0.5).alias("clean"), "ytm")
