"""Issuance events, tap detection and issuance summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.daycount import bucket_label, years_between
from ..sources.conventions import LONG_END_MARKETS
from ..sources.landed import active

TAP_STEP_BN = 0.05  # fixed value
EVENT_COLUMNS = ["bond_id", "market", "country", "event_date", "settle_date", "event_type", "amount", "price", "yield", "reopening", "source"]


def tenths(amount_bn: Column) -> Column:
    """Sum of two-decimal amounts to one decimal, half up, in whole hundredths so no binary tie decides."""
    hundredths = F.sum(F.round(amount_bn * 100).cast("bigint"))
    return F.floor((hundredths + 5) / 10).cast("double") / 10.0


def rounded_years(later: Column, earlier: Column) -> Column:
    return F.bround(years_between(later, earlier), 0).cast("int")


def bond_issuance(bonds: DataFrame, idle: DataFrame) -> DataFrame:
    """One row per active linker with its original tenor and sizes in bn; ``idle`` lists ids that never trade."""
    known = active(bonds, idle).where(F.col("linked") & F.col("issue").isNotNull() & F.col("maturity").isNotNull())
    return known.select(
        "market", "country", "bond_id", F.col("issue").alias("issue_date"), F.year("issue").alias("issue_year"),
        "maturity", F.year("maturity").alias("maturity_year"), rounded_years(F.col("maturity"), F.col("issue")).alias("orig_tenor"),
        F.round(F.col("amt_issued") / 1e9, 2).alias("amt_issued_bn"), F.round(F.col("amt_out") / 1e9, 2).alias("amt_out_bn"),
    )


def reopening_events(issuance: DataFrame, taps: DataFrame) -> DataFrame:
    """Taps joined to the line of their bond."""
    t = taps.select("bond_id", "event_date", "amount")
    joined = t.join(issuance.select("bond_id", "market", "maturity", "orig_tenor"), "bond_id")
    return joined.select(
        "market", "bond_id", "event_date", F.year("event_date").alias("event_year"), F.lit("reopening").alias("type"),
        F.round(F.col("amount") / 1e9, 2).alias("amt_bn"), "orig_tenor",
        rounded_years(F.col("maturity"), F.col("event_date")).alias("remaining_tenor"), "maturity", F.lit("taps").alias("source"),
    )


def events_log(issuance: DataFrame, taps: DataFrame) -> DataFrame:
    """Every new issue and every reopening, one row each."""
    new = issuance.select(
        "market", "bond_id", F.col("issue_date").alias("event_date"), F.col("issue_year").alias("event_year"), F.lit("new").alias("type"),
        F.coalesce("amt_issued_bn", "amt_out_bn").alias("amt_bn"), "orig_tenor", F.col("orig_tenor").alias("remaining_tenor"),
        "maturity", F.lit("static").alias("source"),
    )
    return new.unionByName(reopening_events(issuance, taps))


def issue_events_static(bonds: DataFrame) -> DataFrame:
    """One original-issue row per linked bond."""
    return bonds.where("linked").select(
        "bond_id", "market", "country", F.col("issue").alias("event_date"), F.col("dated").alias("settle_date"),
        F.lit("issue").alias("event_type"), F.col("amt_issued").alias("amount"), F.lit(False).alias("reopening"), F.lit("static").alias("source"),
    )


def step_ups(outstanding: DataFrame, min_step_bn: float = TAP_STEP_BN) -> DataFrame:
    """Rises of the outstanding amount above the step; bonds whose history never moves are skipped."""
    w = Window.partitionBy("bond_id").orderBy("date")
    known = outstanding.where(F.col("amount").isNotNull())
    moves = known.withColumn("step", F.col("amount") - F.lag("amount").over(w))
    # a bond with one distinct amount has no step at all, so the skip needs no separate pass
    return moves.where(F.col("step") > min_step_bn * 1e9).select(
        "bond_id", F.col("date").alias("event_date"), F.lit("reopening").alias("event_type"), F.col("step").alias("amount"),
        F.lit(True).alias("reopening"), F.lit("step").alias("source"),
    )


def union_events(*parts: DataFrame) -> DataFrame:
    """Stack event sources on the canonical columns; what a source lacks is null."""
    padded = []
    for part in parts:
        missing = [F.lit(None).cast("double" if c in ("amount", "price", "yield") else "date" if c.endswith("_date") else "string").alias(c)
                   for c in EVENT_COLUMNS if c not in part.columns]
        padded.append(part.select("*", *missing).select(*EVENT_COLUMNS))
    out = padded[0]
    for part in padded[1:]:
        out = out.unionByName(part)
    return out


def issuance_pivot(events: DataFrame, kind: str, tenors: Sequence[int], values: str = "count") -> DataFrame:
    """Year by original tenor, count or amount; empty cells are zero. Tenors are stated, not discovered."""
    cell = F.count("bond_id") if values == "count" else tenths(F.col("amt_bn"))
    grid = events.where(F.col("type") == kind).groupBy("market", "event_year").pivot("orig_tenor", list(tenors)).agg(cell)
    return grid.select("market", "event_year", *[F.coalesce(F.col(str(t)), F.lit(0)).alias(f"t{t}y") for t in tenors])


def combined_cell(new: Column, taps: Column) -> Column:
    """``N``, ``N+Rx``, ``Rx`` or blank."""
    return (
        F.when((new > 0) & (taps > 0), F.concat(new.cast("string"), F.lit("+"), taps.cast("string"), F.lit("x")))
        .when(taps > 0, F.concat(taps.cast("string"), F.lit("x"))).when(new > 0, new.cast("string")).otherwise("")
    )


def issuance_pivot_combined(events: DataFrame, tenors: Sequence[int]) -> DataFrame:
    """Both event types in one cell: conditional counts in a single aggregation."""
    count = lambda t, kind: F.count_if((F.col("orig_tenor") == t) & (F.col("type") == kind))
    counted = events.groupBy("market", "event_year").agg(
        *[count(t, kind).alias(f"{kind}_{t}") for t in tenors for kind in ("new", "reopening")]
    )
    return counted.select("market", "event_year", *[combined_cell(F.col(f"new_{t}"), F.col(f"reopening_{t}")).alias(f"t{t}y") for t in tenors])


def issuance_cells(events: DataFrame) -> DataFrame:
    """The pivots of every tenor in long form: a row per market, year and original tenor with counts, amounts and the combined cell."""
    one = lambda kind: F.col("type") == kind
    counted = events.groupBy("market", "event_year", "orig_tenor").agg(
        F.count_if(one("new")).alias("n_new"), F.count_if(one("reopening")).alias("n_reopening"),
        F.coalesce(tenths(F.when(one("new"), F.col("amt_bn"))), F.lit(0)).alias("new_bn"), F.coalesce(tenths(F.when(one("reopening"), F.col("amt_bn"))), F.lit(0)).alias("reopening_bn"))
    return counted.withColumn("cell", combined_cell(F.col("n_new"), F.col("n_reopening")))


def issuance_long(events: DataFrame) -> DataFrame:
    return events.groupBy("market", "event_year", "orig_tenor", "type").agg(
        F.count("bond_id").alias("n"), tenths(F.col("amt_bn")).alias("amt_bn")
    )


def issuance_summary(issuance: DataFrame, events: DataFrame) -> DataFrame:
    lines = issuance.groupBy("market").agg(
        F.count(F.lit(1)).alias("bonds"), F.min("issue_year").alias("first_year"), F.max("issue_year").alias("last_year"),
        F.min("orig_tenor").alias("min_tenor"), F.max("orig_tenor").alias("max_tenor"), F.round(F.sum("amt_out_bn"), 0).alias("amt_out_bn"),
    )
    taps = events.where(F.col("type") == "reopening").groupBy("market").agg(F.count(F.lit(1)).alias("reopenings"))
    return lines.join(taps, "market", "left").withColumn("reopenings", F.coalesce("reopenings", F.lit(0)))


def same_bond_multi_tap(events: DataFrame) -> DataFrame:
    """Bonds with two or more events in a month. The day list is bounded by the month."""
    month = F.trunc("event_date", "month").alias("month")
    return (
        events.groupBy("market", "bond_id", month)
        .agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("type")), ";").alias("types"),
             F.sum("amt_bn").alias("amt_bn"),
             F.array_join(F.array_sort(F.transform(F.collect_set("event_date"), lambda d: d.cast("string"))), ";").alias("dates"))
        .where(F.col("n") >= 2)
    )


def market_months(events: DataFrame) -> DataFrame:
    """Events, distinct bonds and amount per market and month.

    Bonds are first reduced to one row each, so the distinct count is a plain count and the largest
    market's month is pre-aggregated rather than gathered.
    """
    month = F.trunc("event_date", "month").alias("month")
    per_bond = events.groupBy("market", month, "bond_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amt_bn").alias("amt"))
    return per_bond.groupBy("market", "month").agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("bonds"), F.sum("amt").alias("amt_bn"))


def busy_months(events: DataFrame) -> DataFrame:
    """Months in which two or more different bonds of a market sold."""
    return market_months(events).where(F.col("bonds") >= 2)


def busy_month_members(events: DataFrame) -> DataFrame:
    """The bonds behind each busy month, one row each (the list form of the report)."""
    busy = busy_months(events).select("market", "month")
    members = events.select("market", F.trunc("event_date", "month").alias("month"), "bond_id").distinct()
    return members.join(busy, ["market", "month"], "left_semi")


def auction_density(events: DataFrame) -> DataFrame:
    per_market = market_months(events).groupBy("market").agg(
        F.count(F.lit(1)).alias("auction_months"), F.max("bonds").alias("max_bonds_mo"), F.count_if(F.col("bonds") >= 2).alias("months_2plus_bonds")
    )
    return per_market.withColumn("pct_months_2plus", F.bround(100.0 * F.col("months_2plus_bonds") / F.col("auction_months"), 0).cast("int"))


def long_end(market: Column) -> Column:
    return market.isin(*LONG_END_MARKETS)


def auctions_by_bucket(events: DataFrame) -> DataFrame:
    """Each event with the grid bucket of its remaining life that day."""
    years = years_between(F.col("maturity"), F.col("event_date"))
    return events.withColumn("bucket", bucket_label(years, long_end(F.col("market")))).where(F.col("bucket").isNotNull())


def mart_auctions(events: DataFrame) -> DataFrame:
    """Events with remaining tenor rounded to two decimals before bucketing."""
    years = F.round(years_between(F.col("maturity"), F.col("event_date")), 2)
    out = events.withColumn("remaining_tenor_y", years)
    out = out.withColumn("bucket", bucket_label(F.col("remaining_tenor_y"), long_end(F.col("market"))))
    return out.select("market", "bond_id", "event_date", "type", "amt_bn", "remaining_tenor_y", "bucket", "source")


def lives(events: DataFrame) -> DataFrame:
    """Distinct (market, first event, maturity) lives with how many bonds share each: bounded by the calendar."""
    first = events.groupBy("market", "bond_id", "maturity").agg(F.min("event_date").alias("issued"))
    return first.groupBy("market", "issued", "maturity").agg(F.count(F.lit(1)).alias("bonds"), F.min("bond_id").alias("bond_id"))


def bucket_coverage(events: DataFrame, first_year: int, last_year: int, recent_from: str) -> DataFrame:
    """Per market and bucket: auctions, recent auctions, bonds, and the share of months with a live bond."""
    months = (last_year - first_year + 1) * 12
    alive = lives(events).withColumn(
        "mid", F.explode(F.expr(f"transform(sequence(DATE'{first_year}-01-01', DATE'{last_year}-12-01', interval 1 month), m -> last_day(m))"))
    ).where((F.col("issued") <= F.col("mid")) & (F.col("mid") <= F.col("maturity")))
    label = bucket_label(years_between(F.col("maturity"), F.col("mid")), long_end(F.col("market")))
    present = alive.select("market", label.alias("bucket"), "mid").where(F.col("bucket").isNotNull()).distinct()
    presence = present.groupBy("market", "bucket").agg(F.bround(100.0 * F.count(F.lit(1)) / months, 0).cast("int").alias("presence_pct"))
    tagged = auctions_by_bucket(events)
    per_bond = tagged.groupBy("market", "bucket", "bond_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_date") >= F.lit(recent_from).cast("date")).alias("recent")
    )
    sold = per_bond.groupBy("market", "bucket").agg(F.sum("n").alias("auctions_all"), F.sum("recent").alias("auctions_recent"), F.count(F.lit(1)).alias("bonds"))
    both = sold.join(presence, ["market", "bucket"], "full")
    return both.select("market", "bucket", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("auctions_all", "auctions_recent", "bonds", "presence_pct")])


def _occupied(alive: DataFrame) -> DataFrame:
    """Market, bucket, year and cell from lives and days ``mid``: maturity year of the bond nearest the grid point, starred if several."""
    from ..functions.daycount import BUCKET_TARGETS

    alive = alive.where((F.col("issued") <= F.col("mid")) & (F.col("mid") <= F.col("maturity")))
    rem = years_between(F.col("maturity"), F.col("mid"))
    alive = alive.withColumn("rem", rem).withColumn("bucket", bucket_label(F.col("rem"), long_end(F.col("market")))).where(F.col("bucket").isNotNull())
    targets = F.create_map(*[F.lit(x) for pair in BUCKET_TARGETS.items() for x in pair])
    best = alive.groupBy("market", "bucket", F.year("mid").alias("year")).agg(
        F.min(F.struct(F.abs(F.col("rem") - F.element_at(targets, F.col("bucket"))).alias("off"), F.year("maturity").alias("my"), "bond_id")).alias("b"),
        F.sum("bonds").alias("bonds"),
    )
    cell = F.concat(F.substring(F.col("b.my").cast("string"), 3, 2), F.when(F.col("bonds") > 1, "*").otherwise(""))
    return best.select("market", "bucket", "year", cell.alias("cell"))


def bucket_occupancy(events: DataFrame, years: Sequence[int]) -> DataFrame:
    """Bucket by stated year at 30 June, one column a year."""
    days = F.explode(F.array(*[F.lit(f"{y}-06-30").cast("date") for y in years]))
    grid = _occupied(lives(events).withColumn("mid", days)).groupBy("market", "bucket").pivot("year", list(years)).agg(F.max("cell"))
    return grid.select("market", "bucket", *[F.coalesce(F.col(str(y)), F.lit("·")).alias(f"y{y}") for y in years])


def bucket_occupancy_years(events: DataFrame) -> DataFrame:
    """Bucket by year at 30 June, one row for each occupied cell of every year from the first to the last event."""
    last = events.agg(F.max(F.year("event_date"))).first()[0]
    own = F.sequence(F.year("issued"), F.least(F.year("maturity"), F.lit(last)))
    alive = lives(events).where(F.year("issued") <= F.least(F.year("maturity"), F.lit(last)))
    return _occupied(alive.withColumn("mid", F.explode(F.transform(own, lambda y: F.make_date(y, F.lit(6), F.lit(30))))))
