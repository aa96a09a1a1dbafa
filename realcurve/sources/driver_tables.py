"""The instrument panel derived from the driver tables.

Every frame is a lazy plan over the parquet tables: raw rows are reduced to one row per (key, day)
with map-side combine before anything else, so a supplier, customer or day that holds a third of
the raw rows never travels as one group.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .conventions import COUNTRIES

CALENDAR_SCOPE = "sequence of days, bounded by the calendar"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_mean(col: str) -> Column:
    """Mean of a two-decimal amount from integer cents: the same whatever order rows arrive in."""
    return F.sum(F.round(F.col(col) * 100).cast("bigint")) / F.count(col) / 100.0


def weekday(d: Column) -> Column:
    """Monday is 0."""
    return F.weekday(d)


def orders(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*cols, F.col("o_orderdate").cast("date").alias("date"))


def bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bond static: one row per supplier."""
    k = F.col("bond_id")
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("bond_id"), "s_nationkey")
    base = base.withColumns(
        {
            "linked": k % 2 == 0,
            "tenor_y": F.element_at(F.array(F.lit(5), F.lit(10), F.lit(30)), (F.expr("(bond_id div 2) % 3") + 1).cast("int")),
            "country": F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]), (F.col("s_nationkey") % 5 + 1).cast("int")),
            "static_freq": F.expr("cast(1 + (bond_id div 3) % 2 as int)"),
            "coupon": 0.25 * (1 + k % 16),
            "dated": F.add_months(F.lit("1995-06-15").cast("date"), (7 * k % 36).cast("int")),
            "base_index": (100 + k % 7).cast("double"),
            "amt_issued": 1e9 * (1 + k % 9),
        }
    )
    market = (
        F.when(F.col("country") == "FR", F.when(F.expr("(bond_id div 10) % 2 = 0"), "FR_OATEI").otherwise("FR_OATI"))
        .when(F.col("country") == "IT", F.when(k % 17 == 4, "IT_ITALIA").otherwise("IT_BTPEI"))
        .when(F.col("country") == "ES", "ES_EI")
        .when(F.col("country") == "DE", "DE_EI")
        .otherwise(F.when(k % 19 == 6, "UK_8M").otherwise("UK_3M"))
    )
    return base.select(
        "bond_id", "linked",
        F.when(F.col("linked"), "linked").otherwise("nominal").alias("leg"),
        F.concat(F.col("tenor_y").cast("string"), F.lit("y")).alias("tenor"),
        F.when(F.col("linked"), market).alias("market"),
        F.when(F.col("linked"), market).otherwise(F.concat(F.lit("NOM_"), F.col("country"))).alias("conv_id"),
        F.when(F.col("linked"), "US_LINKED").otherwise("US_NOMINAL").alias("us_conv_id"),
        "country", "static_freq", "coupon", "dated", F.col("dated").alias("issue"),
        F.add_months("dated", F.col("tenor_y") * 12).alias("maturity"),
        "base_index", "amt_issued", (F.col("amt_issued") + 5e8 * (k % 4)).alias("amt_out"),
        F.coalesce(market.isin("IT_ITALIA", "UK_8M") & F.col("linked"), F.lit(False)).alias("deferred"),
    )


def raw_quotes(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """One quote per bond and day. ``only`` (a ``bond_id`` frame) prunes the scan before the shuffle."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("bond_id"), F.col("l_shipdate").cast("date").alias("date"),
        "l_discount", "l_tax", "l_linenumber",
    )
    if only is not None:
        lines = lines.join(only.select("bond_id"), "bond_id", "left_semi")
    daily = lines.groupBy("bond_id", "date").agg(
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("disc"),
        F.sum(F.round(F.col("l_tax") * 100).cast("bigint")).alias("tax"),
        F.sum(F.col("l_linenumber").cast("bigint")).alias("lines"),
        F.count(F.lit(1)).alias("n"),
    )
    return daily.select(
        "bond_id", "date",
        (90.0 + 2.0 * (F.col("disc") / F.col("n"))).alias("clean"),
        (0.5 + 0.5 * (F.col("tax") / F.col("n"))).alias("ytm"),
        F.when(F.col("date") >= F.lit("2000-01-01").cast("date"), 1.0 + F.col("lines") / F.col("n") / 1000.0).alias("vendor_ir"),
    )


def quoted_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bonds that have a quote."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("bond_id")).distinct()


def last_quote_month(spark: SparkSession, sf_dir: str) -> datetime.date | None:
    """The month of the newest quote."""
    return table(spark, sf_dir, "lineitem").agg(F.trunc(F.max("l_shipdate"), "month")).first()[0]


def quote_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late revisions of quotes, one per event: the user as bond, days spread over the quoted years. The vendor's ratio isn't revised."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("bond_id"), F.date_add(F.lit("1996-01-01").cast("date"), (F.col("event_id") * 37 % 2000).cast("int")).alias("date"),
        (90.0 + F.col("value") / 100.0).alias("clean"), (0.5 + F.col("event_id") % 50 / 100.0).alias("ytm"), F.lit(None).cast("double").alias("vendor_ir"),
        F.col("ts").cast("timestamp").alias("ts"), "event_id")


def quotes(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Quotes inside the life of the bond (static joined on)."""
    q = raw_quotes(spark, sf_dir, only)
    return q.join(bonds(spark, sf_dir), "bond_id").where((F.col("dated") <= F.col("date")) & (F.col("date") < F.col("maturity")))


def daily_status_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        orders(spark, sf_dir, "o_orderstatus", "o_totalprice").where(weekday(F.col("date")) < 5)
        .groupBy("o_orderstatus", "date").agg((exact_mean("o_totalprice") / 1e5).alias("value"))
    )


def index_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month-end price index levels that rise with the running order count."""
    monthly = orders(spark, sf_dir).groupBy(F.last_day("date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(CALENDAR_SCOPE))
    share = monthly.select(
        "date",
        (F.sum("n").over(whole.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(whole)).alias("share"),
    )
    pace = {"cpi_nsa": 0.30, "EUR_HICPXT": 0.20, "FR_CPIXT": 0.25, "UK_RPI": 0.35, "IT_FOIXT": 0.22}
    levels = F.explode(F.array(*[F.struct(F.lit(s).alias("series_id"), (100.0 * (1.0 + p * F.col("share"))).alias("value")) for s, p in pace.items()]))
    out = share.select("date", levels.alias("l")).select("l.series_id", "date", "l.value")
    unpublished = (F.col("series_id") == "UK_RPI") & (F.col("date") == F.lit("1998-07-31").cast("date"))
    return out.where(~unpublished)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long macro table: repo rates per day and price indices per month-end."""
    d, day = F.col("date"), F.dayofmonth("date")
    rate = daily_status_rates(spark, sf_dir)
    named = {
        "F": [("gcf_treasury", d >= F.lit("1996-03-01")), ("estr_gc", d >= F.lit("1998-01-01")),
              ("rfr_de", (d >= F.lit("1999-01-01")) & (day <= 20)), ("rfr_fr", d >= F.lit("1999-06-01"))],
        "O": [("gc_repo_on", F.lit(True)), ("eonia", F.lit(True)), ("rfr_it", (d >= F.lit("1998-06-01")) & (day > 5))],
        "P": [("fed_funds", F.lit(True)), ("sonia_gc", F.lit(True))],
    }
    tags = F.filter(
        F.array(*[F.when((F.col("o_orderstatus") == s) & keep, F.lit(name)) for s, many in named.items() for name, keep in many]),
        lambda t: t.isNotNull(),
    )
    rates = rate.select(F.explode(tags).alias("series_id"), "date", "value")
    return rates.unionByName(index_levels(spark, sf_dir))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest weekday order of each month between the 10th and 28th: the monthly supply event."""
    day = F.dayofmonth("date")
    eligible = orders(spark, sf_dir, "o_orderkey", "o_custkey", "o_totalprice").where((weekday(F.col("date")) < 5) & day.between(10, 28))
    best = F.min(F.struct((-F.col("o_totalprice")).alias("neg"), "o_orderkey", "o_custkey", "date")).alias("b")
    return eligible.groupBy(F.trunc("date", "month").alias("month")).agg(best).select(
        F.expr("(b.o_custkey div 30) * 2").alias("bond_id"), F.col("b.date").alias("auction_date"),
        (F.col("b.o_orderkey") % 2 == 1).alias("reopening"), (-F.col("b.neg") * 1e4).alias("offering"),
    )


AUCTION_COLUMNS = ["bond_id", "leg", "tenor", "auction_date", "issue_date", "dated_date", "maturity_date", "reopening", "offering"]


def auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Auction calendar: a new issue per bond plus the monthly supply event on a linked bond."""
    b = bonds(spark, sf_dir)
    k = F.col("bond_id")
    new = b.select(
        "bond_id", "leg", "tenor", F.date_sub("dated", 3).alias("auction_date"), F.col("dated").alias("issue_date"),
        F.col("dated").alias("dated_date"), F.col("maturity").alias("maturity_date"), F.lit(False).alias("reopening"),
        F.when(k % 13 == 5, F.lit(None).cast("double")).when(k % 11 == 3, F.lit(2.5e7)).when(k % 7 == 2, F.lit(2.5e7))
        .otherwise(2e9 + 1e7 * (k % 50)).alias("offering"),
    )
    taps = (
        supply(spark, sf_dir).join(b.select("bond_id", "leg", "tenor", "dated", "maturity"), "bond_id")
        .where(F.col("auction_date") > F.col("dated"))
        .select("bond_id", "leg", "tenor", "auction_date", F.date_add("auction_date", 5).alias("issue_date"),
                F.col("dated").alias("dated_date"), F.col("maturity").alias("maturity_date"), "reopening", "offering")
    )
    return new.unionByName(taps).select(*AUCTION_COLUMNS)


def tap_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issuance of the bond their customer block maps to, in cents by bond and day.

    Orders combine to one row per bond and day before they meet the bonds, so a busy block is not a
    hot join key.
    """
    daily = orders(spark, sf_dir, "o_custkey", "o_totalprice").groupBy(F.expr("o_custkey div 15").alias("bond_id"), F.col("date").alias("event_date")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents")
    )
    return daily.join(bonds(spark, sf_dir), "bond_id").where((F.col("event_date") >= F.col("dated")) & (F.col("event_date") < F.col("maturity")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taps of linked bonds by day (orders of one bond and day are one event)."""
    return tap_orders(spark, sf_dir).where("linked").select("bond_id", "market", "country", "event_date", (F.col("cents") * 100.0).alias("amount"))


def outstanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount outstanding by bond and day: issued amount plus the running taps; every tenth bond is flat."""
    w = Window.partitionBy("bond_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    daily = tap_orders(spark, sf_dir).select("bond_id", "amt_issued", F.col("event_date").alias("date"), "cents")
    moved = F.when(F.col("bond_id") % 10 == 0, F.lit(0)).otherwise(F.col("cents"))
    return daily.withColumn("amount", F.col("amt_issued") + F.sum(moved).over(w) * 10.0).select("bond_id", "date", "amount")


def pair_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked bond to the next nominal id; every seventh beta is missing."""
    k = F.col("bond_id")
    return bonds(spark, sf_dir).where("linked").select(
        k.alias("real_id"), (k + 1).alias("nominal_id"), F.when(k % 7 != 0, F.lit(1.0)).alias("beta"),
        F.concat(F.lit("L"), k.cast("string"), F.lit(" vs N"), (k + 1).cast("string")).alias("note"),
    )


def nominal_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comprehensive nominal list; Spain is not in it, so its pool falls back to the pair map."""
    return bonds(spark, sf_dir).where(~F.col("linked") & (F.col("country") != "ES")).select("bond_id", "country", "maturity", "issue", "coupon")


def futures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front and second close per weekday with the contract month each one is."""
    day = F.dayofmonth("date")
    daily = orders(spark, sf_dir, "o_totalprice").where(weekday(F.col("date")) < 5).groupBy("date").agg(
        (50.0 + exact_mean("o_totalprice") / 1e4).alias("front")
    )
    front_gen = F.add_months(F.trunc("date", "month"), F.when(day >= 20, 2).otherwise(1))
    return daily.select(
        "date", "front", F.when(day != 28, 1.01 * F.col("front")).alias("second"),
        front_gen.alias("front_gen"),
        F.when(day % 9 != 0, F.add_months(front_gen, F.when(day == 19, 2).otherwise(1))).alias("second_gen"),
    )


def non_traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that stand for the list of private placements."""
    return bonds(spark, sf_dir).where(F.col("bond_id") % 41 == 8).select("bond_id")
