"""Wide export tables, marts and viewer payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.daycount import month_start
from ..functions.financing import half_spread
from ..functions.ordered import up_to_now, week_ending_friday, weekly_sample
from . import rolls

TENORS = ("5y", "10y", "30y")
LEG = ["bond_id", "notional", "denom", "V", "V_prev", "dirty_real", "index_ratio", "clean", "gross_bp", "fin_bp", "bp", "settle", "days", "gc", "is_roll", "is_coupon"]


def legs_outer(legs: DataFrame) -> DataFrame:
    """Both legs' daily chain side by side, outer on the day: one conditional aggregate, one shuffle."""
    cells = [F.max(F.when(F.col("leg") == leg, F.col(c))).alias(f"{leg}_{c}") for leg in ("linked", "nominal") for c in LEG]
    return legs.groupBy("tenor", "date").agg(*cells)


def tenor_full(legs: DataFrame, auctions: DataFrame, energy: DataFrame | None = None, hedge: DataFrame | None = None) -> DataFrame:
    """Per-day dump of both legs, breakeven, flags, auction flags and sizes, and the hedged return."""
    d = legs_outer(legs)
    flag = lambda c: F.coalesce(F.col(f"linked_{c}"), F.lit(False)) | F.coalesce(F.col(f"nominal_{c}"), F.lit(False))
    out = d.withColumns(
        {
            "settle": F.coalesce("linked_settle", "nominal_settle"), "d": F.coalesce("linked_days", "nominal_days"),
            "gc_repo": F.coalesce("linked_gc", "nominal_gc"), "net_financing_bp": F.col("linked_fin_bp") - F.col("nominal_fin_bp"),
            "r_be_bp": F.col("linked_bp") - F.col("nominal_bp"), "is_roll_day": flag("is_roll"), "is_coupon_day": flag("is_coupon"),
        }
    ).withColumn("is_weekend_or_holiday_step", F.coalesce(F.col("d") > 1, F.lit(False)))
    real = rolls.real_auctions(auctions)
    cells = [F.max((F.col("tenor") == t).cast("int")).alias(f"is_{t}_auction") for t in TENORS]
    size = F.max_by("offering", F.when(F.col("offering").isNotNull(), F.struct("bond_id", "offering"))).alias("size")
    days = real.groupBy(F.col("auction_date").alias("date")).agg(*cells, size)
    out = out.join(F.broadcast(days), "date", "left").withColumns(
        {f"is_{t}_auction": F.coalesce(F.col(f"is_{t}_auction") == 1, F.lit(False)) for t in TENORS}
    ).withColumn("auction_size_bn", F.round(F.col("size") / 1e9, 3)).drop("size")
    w = up_to_now(["tenor"], "date")
    run = lambda c: F.when(F.col(c).isNotNull(), F.sum(c).over(w))
    out = out.withColumns({"cum_linked_bp": run("linked_bp"), "cum_nominal_bp": run("nominal_bp"), "cum_be_bp": run("r_be_bp")})
    if energy is None or hedge is None:
        return out
    gas = energy.select("date", F.col("front").alias("front_gas"), F.col("is_roll").alias("is_roll_gas"), F.col("usd_per_contract").alias("usd_gas"), F.col("r_bp").alias("r_bp_gas"))
    out = out.join(F.broadcast(gas), "date", "left").withColumn("month", month_start(F.col("date"))).join(F.broadcast(hedge), ["tenor", "month"], "left")
    ratio = lambda beta: F.col("b_linked") - beta * F.col("b_nominal")
    move = F.coalesce("usd_gas", F.lit(0.0)) / 1e5
    out = out.withColumns({"contracts_be100": ratio(1.0), "contracts_be75": ratio(0.75), "r_be75_bp": F.col("linked_bp") - 0.75 * F.col("nominal_bp")})
    out = out.withColumns(
        {"r_be100_hedged_bp": F.col("r_be_bp") - F.coalesce("contracts_be100", F.lit(0.0)) * move,
         "r_be75_hedged_bp": F.col("r_be75_bp") - F.coalesce("contracts_be75", F.lit(0.0)) * move}
    )
    return out.withColumns({"cum_be100_hedged_bp": run("r_be100_hedged_bp"), "cum_be75_hedged_bp": run("r_be75_hedged_bp")})


def returns_export(returns: DataFrame, x_linked: float = 0.0, x_nominal: float = 0.0) -> DataFrame:
    """Half-spread returns with running sums."""
    d = half_spread(returns, x_linked, x_nominal)
    w = up_to_now(["tenor"], "date")
    run = lambda c: F.when(F.col(c).isNotNull(), F.sum(c).over(w))
    return d.select("tenor", "date", "r_linked_bp", "r_nominal_bp", "r_be_bp", "long_be_bp", "short_be_bp", run("long_be_bp").alias("cum_long_be_bp"),
                    run("short_be_bp").alias("cum_short_be_bp"), run("r_be_bp").alias("cum_be_mid_bp"))


SHEET = ["bond_id", "country", "program", "date", "settlement_date", "clean", "ytm", "accrued", "index_ratio", "vendor_ir", "dirty_real", "V",
         "V_prev", "denom", "dV", "coupon_cash", "d", "gc_repo", "financing", "pnl", "gross_bp", "fin_bp", "bp", "cum_bp"]


def bond_sheet(returns: DataFrame, bonds: DataFrame, conv: DataFrame) -> DataFrame:
    """Per-bond export frame with country and program."""
    named = bonds.select("bond_id", "conv_id").join(F.broadcast(conv.select("conv_id", "country", "program")), "conv_id").drop("conv_id")
    return returns.join(named, "bond_id").withColumnsRenamed({"gc": "gc_repo", "settle": "settlement_date", "days": "d"}).select(*SHEET)


def isin_directory(bonds: DataFrame, pair_map: DataFrame) -> DataFrame:
    """Every linker and mapped nominal with its role and, for a linker, its comparator.

    Static values win over what the map implies.
    """
    linkers = bonds.where("linked").select("bond_id", F.lit("linker").alias("role"))
    nominals = pair_map.select(F.col("nominal_id").alias("bond_id")).distinct().select("bond_id", F.lit("nominal").alias("role"))
    nominals = nominals.join(linkers.select("bond_id"), "bond_id", "left_anti")
    comparator = pair_map.groupBy(F.col("real_id").alias("bond_id")).agg(F.min("nominal_id").alias("comparator_id"))
    static = bonds.select("bond_id", "country", "coupon", "maturity")
    return linkers.unionByName(nominals).join(static, "bond_id", "left").join(comparator, "bond_id", "left").select(
        "bond_id", "role", "country", "coupon", "maturity", F.when(F.col("role") == "linker", F.col("comparator_id")).alias("comparator_id")
    )


def mart_bonds(bonds: DataFrame, conv: DataFrame) -> DataFrame:
    """One row per linker of the universe, coupon included."""
    programs = conv.select(F.col("conv_id").alias("market"), "program")
    return bonds.where("linked").join(F.broadcast(programs), "market").select("bond_id", "market", "country", "program", "maturity", F.col("issue").alias("first_issue"), "coupon")


def window_table(returns: DataFrame, start: str | None = None, end: str | None = None, x_linked: float = 0.0, x_nominal: float = 0.0,
                 freq: str = "auto", max_daily_span: int = 45) -> DataFrame:
    """Daily or monthly returns over a window with a totals row; sums skip nulls.

    ``auto`` shows days when the window's own span is short, decided per tenor inside the plan.
    """
    cols = ["r_linked_bp", "r_nominal_bp", "r_be_bp", "long_be_bp", "short_be_bp"]
    d = half_spread(returns, x_linked, x_nominal).select("tenor", "date", *cols)
    if start is not None:
        d = d.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        d = d.where(F.col("date") <= F.lit(end).cast("date"))
    d = d.where(F.coalesce(*[F.col(c) for c in cols]).isNotNull())
    if freq == "auto":
        span = d.groupBy("tenor").agg(F.datediff(F.max("date"), F.min("date")).alias("span"))
        d = d.join(F.broadcast(span), "tenor").withColumn("daily", F.col("span") <= max_daily_span)
    else:
        d = d.withColumn("daily", F.lit(freq == "D"))
    label = F.when(F.col("daily"), F.date_format("date", "yyyy-MM-dd")).otherwise(F.date_format("date", "yyyy-MM"))
    # a rollup over (tenor, period) gives the rows and each tenor's total in one aggregation
    rolled = d.withColumn("period", label).rollup("tenor", "period").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in cols])
    return rolled.where(F.col("tenor").isNotNull()).withColumn("period", F.coalesce("period", F.lit("TOTAL")))


def monthly_table(series: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Month sums of the chosen series plus a TOTAL row, by rollup."""
    labelled = series.withColumn("period", F.date_format("date", "yyyy-MM"))
    rolled = labelled.rollup("tenor", "period").agg(*[F.sum(c).alias(c) for c in cols])
    return rolled.where(F.col("tenor").isNotNull()).withColumn("period", F.coalesce("period", F.lit("TOTAL")))


def slip_cumulative(series: DataFrame, by: Sequence[str], fin: str, gc: str = "gc") -> DataFrame:
    """Weekly level of the running half-spread sensitivity: sum of financing per unit of positive rate."""
    unit = F.when(F.col(gc) > 0, F.col(fin) / F.col(gc))
    run = series.withColumn("u", unit).where(F.col("u").isNotNull()).withColumn("slip", F.sum("u").over(up_to_now(by, "date")))
    week = F.next_day(F.date_sub("date", 1), "FRI")
    return run.groupBy(*by, week.alias("week")).agg(F.max_by("slip", "date").alias("slip"))


def view_payload(returns: DataFrame, gas: DataFrame) -> DataFrame:
    """Per tenor and year: the day arrays a viewer draws, as JSON. A document holds at most one year."""
    d = returns.where(F.col("r_be_bp").isNotNull()).join(F.broadcast(gas.select("date", F.col("usd_per_contract").alias("g"))), "date", "left")
    day = F.struct("date", F.round("r_linked_bp", 4).alias("rT"), F.round("r_nominal_bp", 4).alias("rU"), F.coalesce("days", F.lit(0)).alias("dd"),
                   F.round(F.coalesce("g", F.lit(0.0)), 2).alias("g"))
    docs = d.groupBy("tenor", F.year("date").alias("year")).agg(F.array_sort(F.collect_list(day)).alias("days"))
    return docs.select("tenor", "year", F.size("days").alias("n_days"), F.to_json("days").alias("payload"))


def hedge_payload(leg_betas: DataFrame, windows: Sequence[str] = ("2y", "5y")) -> DataFrame:
    """Per tenor and window: month to [linked slope, nominal slope], as a JSON map (a key a month)."""
    entry = lambda w: F.struct(F.lit(w).alias("window"), F.col(f"b_linked_{w}").alias("bt"), F.col(f"b_nominal_{w}").alias("bu"))
    long = leg_betas.select("tenor", "month", F.explode(F.array(*[entry(w) for w in windows])).alias("e")).select("tenor", "month", "e.*")
    known = long.where(F.col("bt").isNotNull() & F.col("bu").isNotNull())
    cell = F.struct(F.date_format("month", "yyyy-MM").alias("ym"), F.array(F.round("bt", 4), F.round("bu", 4)).alias("b"))
    docs = known.groupBy("tenor", "window").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return docs.select("tenor", "window", F.size("cells").alias("months"), F.to_json(F.map_from_entries("cells")).alias("payload"))


SERIES_KEY = ["market", "kind", "key"]


def _weekly_series(rows: DataFrame, values: dict[str, str]) -> DataFrame:
    """Last known value of each week and series, as ``values`` names them."""
    return weekly_sample(rows, SERIES_KEY, "date", list(values)).withColumnsRenamed(values)


def _slip_series(rows: DataFrame, fin: str, out: str, gc: str = "gc") -> DataFrame:
    return slip_cumulative(rows, SERIES_KEY, fin, gc).withColumnRenamed("slip", out)


def _bond_weeks(rows: DataFrame, by: Sequence[str], level: str, fin: str, out: str, slip: str) -> DataFrame:
    """Weekly level and slip of each bond in one pass; windows and weeks stay in the partitions of the bond's walk."""
    unit = F.when(F.col("gc") > 0, F.col(fin) / F.col("gc"))
    run = rows.withColumn("__u", unit).withColumn("__slip", F.sum("__u").over(up_to_now(by, "date")))
    known = lambda c, seen: F.max_by(c, F.when(F.col(seen).isNotNull(), F.col("date")))
    return run.groupBy(*by, week_ending_friday(F.col("date")).alias("week")).agg(known(level, level).alias(out), known("__slip", "__u").alias(slip))


def market_series(buckets: DataFrame, bonds: DataFrame, pairs: DataFrame, crude: DataFrame, ratios: DataFrame) -> DataFrame:
    """Weekly levels that a market's page draws: ``market, kind, key, week, out, be, slip_l, slip_n, crude, crude_b``.

    Series of buckets (with the crude contracts a bucket's ``ratios`` row names, and then crude's own level) and of bonds (``bonds`` are returns with
    their market, ``pairs`` the breakevens of those that have one). A week shows where the outright level is known. ``crude`` is cumulated over all its days.
    Returns and breakevens of bonds are each read once and meet as weeks.
    """
    as_bucket = buckets.withColumns({"kind": F.lit("bucket"), "key": F.col("bucket")})
    known = as_bucket.groupBy(*SERIES_KEY).agg(F.count("r_be_bp").alias("__n")).where(F.col("__n") > 0).drop("__n")
    be_bucket = as_bucket.join(known, SERIES_KEY, "left_semi")
    out = _weekly_series(as_bucket, {"cum_linked_bp": "out"}).where(F.col("out").isNotNull())
    for part in (_weekly_series(be_bucket, {"cum_be_bp": "be"}), _slip_series(as_bucket, "linked_fin_bp", "slip_l"), _slip_series(be_bucket, "nominal_fin_bp", "slip_n")):
        out = out.join(part, [*SERIES_KEY, "week"], "left")
    level = crude.select(F.lit(1).alias("__one"), "date", "usd_per_contract").withColumn("crude", F.sum("usd_per_contract").over(up_to_now(["__one"], "date")))
    weeks = weekly_sample(level, ["__one"], "date", ["crude"]).select("week", "crude")  # a row a week
    held = ratios.select("market", F.lit("bucket").alias("kind"), F.col("bucket").alias("key"), F.col("crude_b"))
    out = out.join(held, SERIES_KEY, "left").join(F.broadcast(weeks), "week", "left")
    out = out.withColumn("crude", F.when(F.col("crude_b").isNotNull(), F.col("crude")))
    own = _bond_weeks(bonds, ["bond_id", "market"], "cum_bp", "fin_bp", "out", "slip_l").where(F.col("out").isNotNull())
    paired = _bond_weeks(pairs, ["real_id"], "cum_be_bp", "nominal_fin_bp", "be", "slip_n").withColumnRenamed("real_id", "bond_id")
    both = own.join(paired, ["bond_id", "week"], "left").withColumns({"kind": F.lit("bond"), "key": F.col("bond_id").cast("string")}).drop("bond_id")
    return out.unionByName(both, allowMissingColumns=True)


def market_payload(series: DataFrame) -> DataFrame:
    """``market, kind, key, weeks, payload``: each series of ``market_series`` as one JSON document of equally long arrays, levels in whole points.

    An array that is null throughout is left out. A document is as long as its calendar; a market's documents are its rows.
    """
    whole = lambda c: F.bround(F.col(c), 0).cast("long").alias(c)
    cells = series.select(*SERIES_KEY, "crude_b", F.struct("week", *[whole(c) for c in ("out", "be", "slip_l", "slip_n", "crude")]).alias("c"))
    docs = cells.groupBy(*SERIES_KEY).agg(F.first("crude_b").alias("crude_b"), F.array_sort(F.collect_list("c")).alias("c"))
    column = lambda c: F.when(F.exists("c", lambda e: e[c].isNotNull()), F.transform("c", lambda e: e[c])).alias(c)
    x = F.transform("c", lambda e: F.date_format(e["week"], "yyyy-MM-dd")).alias("x")
    return docs.select(*SERIES_KEY, F.size("c").alias("weeks"), F.to_json(F.struct(x, *[column(c) for c in ("out", "be", "slip_l", "slip_n", "crude")], F.round("crude_b", 4).alias("crude_b"))).alias("payload"))
