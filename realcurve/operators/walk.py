"""The financed daily return: per bond end to end, and spliced across on-the-run rolls.

One shuffle on ``bond_id`` carries the whole walk: the static join, the lags, the monthly sizing
and the running sum all use the same partitioning and the same sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.daycount import month_start
from ..functions.ordered import up_to_now
from ..functions.pricing import bond_metrics
from . import refindex

SIZING_USD = 1.0e7  # fixed value: face scale giving 100k of DV01


def coupon_freq(conv_freq: Column, static_freq: Column, default: Column) -> Column:
    """Market rule, else the bond's own positive frequency, else the country norm, else two."""
    return F.coalesce(conv_freq, F.when(static_freq > 0, static_freq), default, F.lit(2))


STATIC = ["bond_id", "coupon", "freq", "dated", "maturity", "base_index", "index_id", "rounding", "dri_base"]


def bond_rules(bonds: DataFrame, conv: DataFrame, series: DataFrame, conv_key: str = "conv_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Static with its market rules, coupon frequency and base reference index, one row per bond."""
    rules = conv.select(F.col("conv_id").alias(conv_key), F.col("freq").alias("conv_freq"), "freq_default", "rounding", *refindex.RATIO_KEYS)
    ruled = bonds.join(F.broadcast(rules), conv_key).withColumn(
        "freq", coupon_freq(F.col("conv_freq"), F.col("static_freq"), F.col("freq_default"))
    )
    return refindex.base_reference(ruled, series).select(*STATIC, F.col(conv_key).alias("conv_id"), *keep)


def bounded_rules(rules: DataFrame, days: DataFrame) -> DataFrame:
    """The rules with the first and last day of their market; landed, their true size lets the quotes meet them without a shuffle."""
    ends = days.groupBy("conv_id").agg(F.min("date").alias("__lo"), F.max("date").alias("__hi"))
    return rules.join(F.broadcast(ends), "conv_id", "left")  # the ends ride on the rules: no further join of the quotes


def value_quotes(quotes: DataFrame, rules: DataFrame, days: DataFrame) -> DataFrame:
    """Quotes joined to their bond's rules and the day dimension, valued at settlement.

    ``days`` (market_days) is bounded by markets times calendar days, hence the broadcast; the bond
    join is left to the optimizer because the number of bonds grows with the data. A quote counts if its settlement
    lies in the bond's life; days outside the day dimension take its first or last row.
    """
    known = quotes.dropna(subset=["clean", "ytm"])  # else the next return would lose its previous mark
    bounded = rules if "__lo" in rules.columns else bounded_rules(rules, days)
    at = F.when(F.col("date").isNotNull(), F.least(F.greatest(F.col("date"), F.col("__lo")), F.col("__hi")))
    marked = known.join(bounded, "bond_id").withColumn("__at", at).drop("__lo", "__hi")
    marked = marked.join(F.broadcast(days.withColumnRenamed("date", "__at")), ["conv_id", "__at"]).drop("__at")
    marked = marked.where((F.col("settle") >= F.col("dated")) & (F.col("settle") < F.col("maturity")))
    ratio = F.when(F.col("index_id").isNull(), F.lit(1.0)).otherwise(
        refindex.index_ratio(F.col("rounding"), F.col("dri"), F.col("dri_base"), F.col("base_index"))
    )
    return bond_metrics(marked.withColumn("index_ratio", ratio))


def lag_mark(metrics: DataFrame, by: Sequence[str] = ("bond_id",), seed: str | None = None) -> DataFrame:
    """Previous surviving row of the same bond; nulls are not skipped. A bond's first row follows its ``seed``, a struct of a mark, if there is one.

    ``denom0`` is the sizing DV01 an epoch starting on this row would use: the previous row's, else
    the row's own.
    """
    w = Window.partitionBy(*by).orderBy("date")
    before = lambda c: F.lag(c).over(w) if seed is None else F.when(F.lag("date").over(w).isNull(), F.col(f"{seed}.{c}")).otherwise(F.lag(c).over(w))
    marked = metrics.withColumns(
        {"prev_date": before("date"), "V_prev": before("V"), "settle_prev": before("settle"), "n_prev": before("n_left"), "dv01_prev": before("dv01")}
    )
    return marked.withColumn("denom0", F.coalesce(F.when(F.col("dv01_prev") != 0, F.col("dv01_prev")), F.col("dv01")))


def epoch_denom(marked: DataFrame, key: str | Sequence[str] = "bond_id", starts: Column | None = None) -> DataFrame:
    """Hold the sizing DV01 of each epoch's first row; by default an epoch is a calendar month of the bond.

    The first row counts even when its value is missing (then the whole epoch has none), hence the
    NaN marker. Same partitioning and order as the lags: no further shuffle or sort.
    """
    if starts is None:
        starts = F.col("prev_date").isNull() | (month_start(F.col("prev_date")) != month_start(F.col("date")))
    opening = F.when(starts, F.coalesce(F.col("denom0"), F.lit(float("nan"))))
    held = F.last(opening, ignorenulls=True).over(up_to_now([key] if isinstance(key, str) else key, "date"))
    return marked.withColumn("denom", F.nanvl(held, F.lit(None).cast("double")))


def usable(sized: DataFrame) -> Column:
    """Whether a row has a return: a previous mark, both values known and a usable denominator."""
    return sized["prev_date"].isNotNull() & sized["V"].isNotNull() & sized["V_prev"].isNotNull() & (sized["denom"] != 0)


def steps(sized: DataFrame) -> DataFrame:
    """Days and coupon cash since the previous mark."""
    paid = (F.col("n_prev") - F.col("n_left")) * (F.col("coupon") / F.col("freq")) * F.col("index_ratio")
    return sized.withColumns({"days": F.datediff("settle", "settle_prev"), "coupon_cash": paid})


def return_terms(rows: DataFrame) -> DataFrame:
    """What follows row by row from two values, the days and cash between them, the repo rate and the denominator."""
    carried = F.col("days") / F.lit(360.0) * F.col("V_prev")
    rows = rows.withColumns(
        {
            "dV": F.col("V") - F.col("V_prev"),
            "financing": F.coalesce(carried * (F.col("gc") / 100.0), F.lit(0.0)),
            "fin_sens": F.try_divide(carried / 10000.0, F.col("denom")),
        }
    )
    rows = rows.withColumn("pnl", F.col("dV") + F.col("coupon_cash") - F.col("financing"))
    return rows.withColumns(
        {
            "gross_bp": F.try_divide(F.col("dV") + F.col("coupon_cash"), F.col("denom")),
            "fin_bp": F.try_divide("financing", "denom"),
            "bp": F.try_divide("pnl", "denom"),
            "notional": F.try_divide(F.lit(SIZING_USD), "denom"),
            "is_coupon": F.col("coupon_cash") != 0,
        }
    )


def financed_return(sized: DataFrame) -> DataFrame:
    """Daily P&L of rows with a previous mark, both values known and a usable denominator."""
    return return_terms(steps(sized.where(usable(sized))))


RETURN_COLUMNS = ["bond_id", "date", "settle", "clean", "ytm", "accrued", "index_ratio", "vendor_ir", "dirty_real", "V", "V_prev",
                  "dv01", "denom", "notional", "dV", "coupon_cash", "days", "gc", "financing", "pnl", "gross_bp", "fin_bp",
                  "bp", "fin_sens", "is_coupon", "cum_bp"]


def bond_walk(metrics: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every bond walked end to end."""
    walked = financed_return(epoch_denom(lag_mark(metrics)))
    summed = walked.withColumn("cum_bp", F.sum("bp").over(up_to_now(["bond_id"], "date")))
    return summed.select(*RETURN_COLUMNS, *keep)


def leg_walk(metrics: DataFrame, roll_spans: DataFrame, emit_from: str | None = None) -> DataFrame:
    """Splice the active bond of each (leg, tenor) and day.

    ``roll_spans`` (leg, tenor, bond_id, eff, next_eff) has at most one row per roll day, so it is
    broadcast; the equi-key is the bond. The sizing epoch restarts at rolls and month starts.
    ``is_roll`` is decided on the full history, before ``emit_from`` cuts.
    """
    marked = lag_mark(metrics)
    held = marked.join(F.broadcast(roll_spans), "bond_id").where(
        (F.col("date") >= F.col("eff")) & (F.col("next_eff").isNull() | (F.col("date") < F.col("next_eff")))
    )
    held = held.withColumn("series", F.concat_ws("|", "leg", "tenor"))
    w = Window.partitionBy("series").orderBy("date")
    seen = held.withColumns({"__eff": F.lag("eff").over(w), "__day": F.lag("date").over(w)})
    starts = F.col("__eff").isNull() | (F.col("__eff") != F.col("eff")) | (month_start(F.col("__day")) != month_start(F.col("date")))
    walked = financed_return(epoch_denom(seen, "series", starts))
    previous = F.lag("bond_id").over(w)
    walked = walked.withColumn("is_roll", F.coalesce(previous != F.col("bond_id"), F.lit(False)))
    if emit_from is not None:
        walked = walked.where(F.col("date") >= F.lit(emit_from).cast("date"))
    return walked.select("leg", "tenor", *[c for c in RETURN_COLUMNS if c not in ("cum_bp", "vendor_ir")], "is_roll")


def tenor_returns(legs: DataFrame) -> DataFrame:
    """Both legs of a tenor side by side with the breakeven and running sums (outer on the day).

    Written as one conditional aggregate over (tenor, date): the legs meet in a single shuffle.
    """
    pick = lambda leg, c: F.max(F.when(F.col("leg") == leg, F.col(c)))
    both = legs.groupBy("tenor", "date").agg(
        pick("linked", "bp").alias("r_linked_bp"), pick("nominal", "bp").alias("r_nominal_bp"),
        pick("linked", "fin_sens").alias("s_linked"), pick("nominal", "fin_sens").alias("s_nominal"),
        F.coalesce(pick("linked", "days"), pick("nominal", "days")).alias("days"),
    ).withColumn("r_be_bp", F.col("r_linked_bp") - F.col("r_nominal_bp"))
    w = up_to_now(["tenor"], "date")
    return both.withColumns(
        {f"cum_{k}_bp": F.when(F.col(f"r_{k}_bp").isNotNull(), F.sum(f"r_{k}_bp").over(w)) for k in ("linked", "nominal", "be")}
    )
