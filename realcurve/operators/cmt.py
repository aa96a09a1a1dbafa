"""Constant-maturity series: which linker each bucket holds, its nearest nominal, and the spliced legs.

Selections are reduced to one candidate per (market, month, maturity day) before any nearest-match
step. Their size is bounded by months times maturity days whatever the number of bonds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.daycount import bucket_label, month_start, years_between
from ..functions.ordered import asof, cum_flat_gap, session_segments
from .issuance import long_end

MARKET_COUNTRY = {"FR_OATEI": "FR", "FR_OATI": "FR", "IT_BTPEI": "IT", "ES_EI": "ES", "DE_EI": "DE", "UK_3M": "GB"}


def first_events(events: DataFrame) -> DataFrame:
    """First event of each bond: its vintage."""
    return events.groupBy("market", "bond_id", "maturity").agg(F.min("event_date").alias("vintage"))


def held_monthly(events: DataFrame, as_of) -> DataFrame:
    """Per market, bucket and month: the latest-vintage bond in the band, issued by the prior month-end.

    Ties go to the longer maturity, then the larger id.
    """
    vintages = first_events(events).groupBy("market", "vintage", "maturity").agg(F.max("bond_id").alias("bond_id"))
    begin = F.add_months(month_start(F.col("vintage")), 1)
    end = F.least(month_start(F.lit(as_of).cast("date")), month_start(F.col("maturity")))
    months = F.when(begin <= end, F.sequence(begin, end, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    grid = vintages.select("market", "vintage", "maturity", "bond_id", F.explode(months).alias("month"))
    grid = grid.where(F.col("maturity") >= F.col("month"))
    grid = grid.withColumn("bucket", bucket_label(years_between(F.col("maturity"), F.col("month")), long_end(F.col("market"))))
    best = F.max(F.struct("vintage", "maturity", "bond_id")).alias("h")
    return grid.where(F.col("bucket").isNotNull()).groupBy("market", "bucket", "month").agg(best).select(
        "market", "bucket", "month", F.col("h.bond_id").alias("bond_id"), F.col("h.maturity").alias("maturity")
    )


def nominal_pool(universe: DataFrame, pair_map: DataFrame, bonds: DataFrame, quoted: DataFrame) -> DataFrame:
    """Quoted nominals of each country; a country with none falls back to its mapped comparators."""
    static = bonds.where(~F.col("linked")).select("bond_id", "country", "maturity", "issue")
    live = quoted.select("bond_id").distinct()
    full = universe.select("bond_id").join(static, "bond_id").join(live, "bond_id", "left_semi")
    mapped = pair_map.select(F.col("nominal_id").alias("bond_id")).distinct().join(static, "bond_id").join(live, "bond_id", "left_semi")
    covered = full.select("country").distinct()
    return full.unionByName(mapped.join(covered, "country", "left_anti")).where(F.col("issue").isNotNull() & F.col("maturity").isNotNull())


def closest_nominal(targets: DataFrame, pool: DataFrame) -> DataFrame:
    """Nearest maturity among nominals issued by the prior month-end and alive after the month start.

    ``targets`` has country, month and maturity. Equal gaps go to the earlier maturity, then the
    smaller id. Candidates combine to one row per (country, month, maturity) and the nearest one on
    either side is an as-of lookup, so no target meets a whole pool.
    """
    days = pool.groupBy("country", "maturity", "issue").agg(F.min("bond_id").alias("bond_id"))
    span = targets.groupBy("country").agg(F.min("month").alias("m_lo"), F.max("month").alias("m_hi"))
    bounded = days.join(F.broadcast(span), "country")
    begin = F.greatest(F.add_months(month_start(F.col("issue")), 1), F.col("m_lo"))
    end = F.least(F.col("m_hi"), month_start(F.col("maturity")))
    months = F.when(begin <= end, F.sequence(begin, end, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    alive = bounded.select("country", "maturity", "bond_id", F.explode(months).alias("month")).where(F.col("maturity") > F.col("month"))
    cand = alive.groupBy("country", "month", "maturity").agg(F.min("bond_id").alias("nominal_id"))
    right = cand.select("country", "month", F.col("maturity").alias("at"), F.col("maturity").alias("nominal_maturity"), "nominal_id")
    left = targets.withColumn("at", F.col("maturity"))
    key = ["country", "month"]
    before = asof(left, right, key, "at", ["nominal_maturity", "nominal_id"], "backward").withColumnsRenamed({"nominal_maturity": "m_b", "nominal_id": "n_b"})
    both = asof(before, right, key, "at", ["nominal_maturity", "nominal_id"], "forward")
    gap_b, gap_f = F.datediff("maturity", "m_b"), F.datediff("nominal_maturity", "maturity")
    use_b = F.col("m_b").isNotNull() & (F.col("nominal_maturity").isNull() | (gap_b <= gap_f))
    picked = both.withColumns(
        {"nominal_id": F.when(use_b, F.col("n_b")).otherwise(F.col("nominal_id")),
         "nominal_maturity": F.when(use_b, F.col("m_b")).otherwise(F.col("nominal_maturity"))}
    )
    return picked.drop("m_b", "n_b", "at")


def holdings(held: DataFrame, pool: DataFrame) -> DataFrame:
    """Monthly holdings with the nominal hedge of the month."""
    country = F.create_map(*[F.lit(x) for pair in MARKET_COUNTRY.items() for x in pair])
    targets = held.withColumn("country", F.element_at(country, F.col("market"))).where(F.col("country").isNotNull())
    return closest_nominal(targets, pool)


def needed_nominals(matched: DataFrame) -> DataFrame:
    """The nominals the matcher ever picks."""
    return matched.where(F.col("nominal_id").isNotNull()).select(F.col("nominal_id").alias("bond_id")).distinct()


def needed_bonds(matched: DataFrame) -> DataFrame:
    """Every bond a bucket ever uses; joined to the raw scan so that nothing else is priced."""
    return matched.select("bond_id").union(needed_nominals(matched)).distinct()


def date_union_grid(returns: DataFrame, held: DataFrame) -> DataFrame:
    """Days on which any bond held in a market has a return."""
    members = held.select("market", "bond_id").distinct()
    return returns.select("bond_id", "date").join(members, "bond_id").select("market", "date").distinct()


LINKED = {"settle": "settle", "days": "days", "gc": "gc", "clean": "linked_clean", "ytm": "linked_ytm", "accrued": "linked_accrued",
          "index_ratio": "linked_ir", "dirty_real": "linked_dirty", "V": "linked_V", "V_prev": "linked_V_prev",
          "notional": "linked_notional", "denom": "linked_dv01", "dV": "linked_dV", "coupon_cash": "linked_coupon",
          "financing": "linked_financing", "gross_bp": "linked_gross_bp", "fin_bp": "linked_fin_bp", "bp": "r_linked_bp"}
NOMINAL = {"clean": "nominal_clean", "ytm": "nominal_ytm", "accrued": "nominal_accrued", "dirty_real": "nominal_dirty", "V": "nominal_V",
           "V_prev": "nominal_V_prev", "notional": "nominal_notional", "denom": "nominal_dv01", "dV": "nominal_dV",
           "coupon_cash": "nominal_coupon", "financing": "nominal_financing", "gross_bp": "nominal_gross_bp",
           "fin_bp": "nominal_fin_bp", "bp": "r_nominal_bp"}


def auction_flags(tagged: DataFrame, matched: DataFrame) -> DataFrame:
    """Sales per market, bucket and day: bond count, amount, and whether the bond held that month is among them. The events are read once."""
    per_bond = tagged.groupBy("market", "bucket", "event_date", "bond_id").agg(F.sum("amt_bn").alias("amt"))
    held = matched.select("market", "bucket", "month", F.col("bond_id").alias("__held"))
    known = per_bond.withColumn("month", month_start(F.col("event_date"))).join(F.broadcast(held), ["market", "bucket", "month"], "left")
    return known.groupBy("market", "bucket", F.col("event_date").alias("date")).agg(
        F.count(F.lit(1)).alias("auction_bonds"), F.round(F.sum("amt"), 3).alias("auction_amount"), F.max(F.col("bond_id") == F.col("__held")).alias("auction_is_held")
    )


def bucket_taps(tagged: DataFrame) -> DataFrame:
    """The bonds sold on each auction day of a bucket, one row each (the list form of the flag)."""
    return tagged.groupBy("market", "bucket", F.col("event_date").alias("date"), "bond_id").agg(F.sum("amt_bn").alias("amt_bn"))


def _role_tags(matched: DataFrame) -> DataFrame:
    """``bond_id, month, tags``: for every market in which a bond has a part in the month, whether its days count for the market's
    grid (a linker held there at any time) and the (bucket, role) cells that it fills. Bounded by bonds ever held times months."""
    span = matched.groupBy("market").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    members = matched.select("market", "bond_id").distinct().join(F.broadcast(span), "market")
    months = members.select("bond_id", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"), "market", F.lit(True).alias("member"))
    cell = lambda c, role: matched.where(F.col(c).isNotNull()).select(F.col(c).alias("bond_id"), "month", "market", F.struct("bucket", F.lit(role).alias("role")).alias("cell"))
    parts = months.unionByName(cell("bond_id", "linked"), allowMissingColumns=True).unionByName(cell("nominal_id", "nominal"), allowMissingColumns=True)
    by_market = parts.groupBy("bond_id", "month", "market").agg(F.max(F.coalesce("member", F.lit(False))).alias("member"), F.collect_list("cell").alias("cells"))
    return by_market.groupBy("bond_id", "month").agg(F.collect_list(F.struct("market", "member", "cells")).alias("tags"))


def _market_days(returns: DataFrame, matched: DataFrame) -> DataFrame:
    """``market, date, month, held``: the market's day grid, each day with the returns of the bonds that its buckets hold.

    The returns are read once: each row meets its bond's tags of the month, and the rows of a market's day meet in one aggregate. A day's list has
    two entries for a bucket at most.
    """
    fields = [c for c in dict.fromkeys([*LINKED, *NOMINAL])]
    rows = returns.select("bond_id", "date", month_start(F.col("date")).alias("month"), F.struct(*fields).alias("v"))
    tagged = rows.join(_role_tags(matched), ["bond_id", "month"]).select("date", "month", "v", F.explode("tags").alias("t"))
    held = F.collect_list(F.when(F.size("t.cells") > 0, F.struct(F.col("t.cells").alias("cells"), "v"))).alias("held")
    return tagged.groupBy(F.col("t.market").alias("market"), "date", "month").agg(F.max("t.member").alias("member"), held).where("member").drop("member")


def _filled(role: str) -> Column:
    """The returns of the bond that fills a role of the row's bucket; null without."""
    fills = lambda e: F.exists(e["cells"], lambda c: (c["bucket"] == F.col("bucket")) & (c["role"] == role))
    return F.get(F.filter("held", fills), 0)["v"]


def bucket_series(returns: DataFrame, matched: DataFrame, tagged: DataFrame) -> DataFrame:
    """Spliced linker and re-picked nominal of every market and bucket on the market's day grid.

    Gaps inside the held span stay in the grid and the sums run flat over them. ``returns`` is read once.
    """
    keys = ["market", "bucket"]
    span = matched.groupBy(*keys).agg(F.min("month").alias("m_lo"), F.max(F.last_day("month")).alias("m_hi"))
    frame = _market_days(returns, matched).join(F.broadcast(span), "market").where((F.col("date") >= F.col("m_lo")) & (F.col("date") <= F.col("m_hi")))
    held = matched.select(*keys, "month", "bond_id", F.col("maturity").alias("linked_maturity"), "nominal_id", "nominal_maturity")
    frame = frame.withColumns({"__linked": _filled("linked"), "__nominal": _filled("nominal")}).join(F.broadcast(held), [*keys, "month"], "left")
    picked = [F.col(f"__linked.{a}").alias(b) for a, b in LINKED.items()] + [F.col(f"__nominal.{a}").alias(b) for a, b in NOMINAL.items()]
    spliced = frame.select(*keys, "date", "bond_id", "linked_maturity", "nominal_id", "nominal_maturity", *picked)
    spliced = spliced.join(auction_flags(tagged, matched), [*keys, "date"], "left")
    nominal_seen = F.col("r_nominal_bp").isNotNull()
    spliced = spliced.withColumns(
        {
            "beta": F.lit(1.0),
            "net_fin_bp": F.col("linked_fin_bp") - F.col("nominal_fin_bp"),
            "r_be_bp": F.col("r_linked_bp") - F.col("r_nominal_bp"),
            "nominal_mat_gap_y": years_between(F.col("nominal_maturity"), F.col("linked_maturity")),
            "is_coupon_day": (F.coalesce("linked_coupon", F.lit(0.0)) != 0) | (F.coalesce("nominal_coupon", F.lit(0.0)) != 0),
            "is_weekend_or_holiday_step": F.coalesce("days", F.lit(0)) > 1,
            "is_auction_date": F.col("auction_bonds").isNotNull(),
            "auction_is_held": F.coalesce("auction_is_held", F.lit(False)),
            "has_nominal": nominal_seen,
        }
    )
    summed = cum_flat_gap(spliced, keys, "date", {"cum_linked_bp": "r_linked_bp", "cum_nominal_bp": "r_nominal_bp", "cum_be_bp": "r_be_bp"})
    previous = F.lag("bond_id").over(Window.partitionBy(*keys).orderBy("date"))
    roll = F.col("bond_id").isNotNull() & ~F.col("bond_id").eqNullSafe(previous)
    return summed.withColumns({"is_roll_day": roll, "held_roll_from": F.when(roll, previous)})


def bucket_summary(series: DataFrame) -> DataFrame:
    """Names, rolls, auctions, days, span, final levels and comparator depth of each bucket."""
    held = F.col("bond_id").isNotNull()
    be = F.col("r_be_bp").isNotNull()
    names = series.where(held).groupBy("market", "bucket", "bond_id").agg(F.lit(1).alias("one")).groupBy("market", "bucket").agg(F.count("one").alias("names"))
    flat = series.groupBy("market", "bucket").agg(
        F.count_if(F.col("is_roll_day")).alias("rolls"), F.count_if(F.col("is_auction_date")).alias("auctions"), F.count_if(held).alias("days_held"),
        F.min(F.when(held, F.col("date"))).alias("first"), F.max(F.when(held, F.col("date"))).alias("last"),
        F.max_by("cum_linked_bp", "date").alias("cum_linked_bp"), F.min(F.when(be, F.col("date"))).alias("be_first"),
        F.bround(100.0 * F.count_if(be) / F.count_if(held), 0).cast("int").alias("be_cov_pct"), F.max_by("cum_be_bp", "date").alias("cum_be_bp"),
    )
    return flat.join(names, ["market", "bucket"])


def hedge_mismatch(series: DataFrame) -> DataFrame:
    """Each held (linker, nominal) pairing: its maturity gap, span and days."""
    keys = ["market", "bucket"]
    paired = series.where(F.col("bond_id").isNotNull() & F.col("nominal_id").isNotNull())
    runs = session_segments(paired, keys, "date", ["bond_id", "nominal_id"])
    return runs.groupBy(*keys, "segment", "bond_id", "nominal_id").agg(
        F.round(F.min_by("nominal_mat_gap_y", "date"), 2).alias("gap_y"), F.min("date").alias("used_from"),
        F.max("date").alias("used_to"), F.count(F.lit(1)).alias("days"),
    )


def worst_mismatch(mismatch: DataFrame, top: int = 20) -> DataFrame:
    """The pairings with the largest absolute gap (a top-k report)."""
    return mismatch.orderBy(F.abs("gap_y").desc(), "market", "bucket", "segment").limit(top)


MART_COLUMNS = ["market", "bucket", "date", "bond_id", "nominal_id", "nominal_mat_gap_y", "r_linked_bp", "r_be_bp", "cum_linked_bp",
                "cum_be_bp", "is_roll_day", "is_auction_date", "auction_bonds", "auction_amount", "auction_is_held"]


def mart_cmt(series: DataFrame) -> DataFrame:
    return series.select(*MART_COLUMNS).withColumnRenamed("bond_id", "held_id")
