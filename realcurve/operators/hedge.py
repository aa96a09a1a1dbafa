"""Energy hedge ratios: aligned dollar pairs, full-sample and walk-forward regressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.daycount import month_start
from ..functions.ordered import asof, up_to_now
from ..functions.stats import moment_columns, ols_columns

BP_USD = 100_000.0  # fixed value: dollars per basis point of a leg
WINDOWS = {"2y": 2, "5y": 5}  # fixed values: trailing years
MIN_DAYS_PER_YEAR = 150
# Static full-sample slopes (linked, nominal) per tenor.
FULL_HEDGE = {"5y": (39.1140, -36.8186), "10y": (4.5349, -44.1762), "30y": (-12.8255, -46.5225)}


def bucket_to_next_day(returns: DataFrame, energy: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Sum each bond day into the first energy day at or after it; days past the last one are dropped.

    The day map is built once over distinct days (bounded by the calendar) and joined to the returns.
    """
    marks = energy.select(F.lit(1).alias("k"), "date", F.col("date").alias("energy_date"))
    days = returns.select("date").distinct().withColumn("k", F.lit(1))
    nxt = asof(days, marks, ["k"], "date", ["energy_date"], "forward").where(F.col("energy_date").isNotNull()).drop("k")
    placed = returns.join(F.broadcast(nxt), "date")
    return placed.groupBy(*by, F.col("energy_date").alias("date")).agg(*[F.sum(c).alias(c) for c in cols])


def aligned_pairs(returns: DataFrame, energy: DataFrame, by: Sequence[str], beta: float = 1.0, partial: bool = False) -> DataFrame:
    """Energy dollars a contract beside the leg dollars that span the same days.

    ``be_usd`` is linked minus beta times nominal. Rows without it are left out, unless ``partial`` keeps the days of one leg only.
    """
    legs = bucket_to_next_day(returns, energy, by, ["r_linked_bp", "r_nominal_bp"])
    usd = energy.select("date", F.col("usd_per_contract").alias("x_usd"))
    met = legs.join(F.broadcast(usd), "date")
    out = met.select(*by, "date", "x_usd", (F.col("r_linked_bp") * BP_USD).alias("linked_usd"), (F.col("r_nominal_bp") * BP_USD).alias("nominal_usd"))
    out = out.withColumn("be_usd", F.col("linked_usd") - beta * F.col("nominal_usd")).where(F.col("x_usd").isNotNull())
    return out if partial else complete(out)


def complete(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("be_usd").isNotNull())


PRODUCTS = {"be": "be_usd", "l": "linked_usd", "n": "nominal_usd"}


def _prefixes(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each pair row with what the rows before it add up to: their number, and for each product the number, sums and products of centred values.

    Values are centred on their group's means, so that differences of two prefixes keep their digits.
    """
    group, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias
    centred = pairs.withColumns({"__x": F.col("x_usd") - F.avg("x_usd").over(group)} | {f"__{k}": F.col(c) - F.avg(c).over(group) for k, c in PRODUCTS.items()})
    sums = [total(F.lit(1.0))("__rows")]
    for k in PRODUCTS:
        y = F.col(f"__{k}")
        x = F.when(y.isNotNull(), F.col("__x"))
        y = F.when(x.isNotNull(), y)
        for name, value in (("c", F.when(y.isNotNull(), 1.0)), ("sx", x), ("sy", y), ("sxx", x * x), ("sxy", x * y), ("syy", y * y)):
            sums.append(total(value)(f"__{k}_{name}"))
    return centred.select(*by, "date", *sums)


def window_moments(pairs: DataFrame, by: Sequence[str], windows: dict[str, int] = WINDOWS) -> DataFrame:
    """Moments of every rebalance window ``[R - years, R)``: ``rows``, ``first_day`` and, for each product, count, sums and centred products.

    A window is the difference of two prefixes, the one at R and the one at its first day, which is looked up as of ``R - years``: no
    day meets a window. Calendar years are stepped from R, as month arithmetic does (a 29 February clips). Windows without rows are left out.
    """
    prefixes = _prefixes(pairs, by)
    names = [c for c in prefixes.columns if c.startswith("__")]
    spans = F.explode(F.array(*[F.struct(F.lit(t).alias("window"), F.lit(y).alias("years")) for t, y in windows.items()]))
    at = prefixes.withColumn("month", month_start(F.col("date"))).groupBy(*by, "month").agg(F.min(F.struct("date", *names)).alias("e"))  # first common day of each month
    marks = at.select(*by, "month", F.col("e.date").alias("rebalance"), F.col("e").alias("end"), spans.alias("s")).select(
        *by, "month", "rebalance", "end", "s.window", "s.years", F.add_months("rebalance", -12 * F.col("s.years")).alias("from_day"),
        F.add_months("rebalance", 2 - 12 * F.col("s.years")).alias("reach_day"))
    opens = prefixes.select(*by, F.col("date").alias("from_day"), F.col("date").alias("first_day"), F.struct(*names).alias("start"))
    met = asof(marks, opens, by, "from_day", ["first_day", "start"], "forward").where(F.col("first_day") < F.col("rebalance"))
    within = lambda c: F.col(f"end.{c}") - F.col(f"start.{c}")
    out = met.select(*by, "month", "rebalance", "window", "years", "reach_day", "first_day", within("__rows").cast("long").alias("rows"), *[within(c).alias(c[2:]) for c in names[1:]], *[F.col(f"end.{c}").alias(f"to_{c[2:]}") for c in names if c.endswith(("sxx", "syy"))])
    for k in PRODUCTS:
        n = F.col(f"{k}_c")
        part = lambda a, b, c, k=k, n=n: F.col(f"{k}_{c}") - F.try_divide(F.col(f"{k}_{a}") * F.col(f"{k}_{b}"), n)
        # what is left of the sum up to here by rounding is no spread
        spread = lambda a, c, k=k, part=part: F.when(part(a, a, c) > 1e-13 * F.col(f"to_{k}_{c}"), part(a, a, c)).otherwise(0.0)
        out = out.withColumns({f"{k}_xx": spread("sx", "sxx"), f"{k}_yy": spread("sy", "syy"), f"{k}_xy": part("sx", "sy", "sxy")})
    return out


def _full_enough(n: str, first: str, per_year: int):
    return (F.col(n) >= F.col("years") * per_year) & (F.col(first) <= F.col("reach_day"))


def window_regressions(pairs: DataFrame, by: Sequence[str], windows: dict[str, int] = WINDOWS,
                       per_year: int = MIN_DAYS_PER_YEAR) -> DataFrame:
    """Breakeven and per-leg regressions of every full window, from its moments."""
    full = window_moments(complete(pairs), by, windows).where(_full_enough("rows", "first_day", per_year))
    fit = moment_columns("be_c", "be_xx", "be_yy", "be_xy")
    slope = lambda k: moment_columns(f"{k}_c", f"{k}_xx", f"{k}_yy", f"{k}_xy")["slope"]
    return full.select(*by, "month", "rebalance", "window", "years", "reach_day", "first_day", "rows", *[c.alias(n) for n, c in fit.items()], slope("l").alias("l_slope"), slope("n").alias("n_slope"))


def walk_forward_ratio(pairs: DataFrame, by: Sequence[str], windows: dict[str, int] = WINDOWS,
                       per_year: int = MIN_DAYS_PER_YEAR) -> DataFrame:
    """Monthly hedge ratio per window; a month is kept if any window is full."""
    regs = window_regressions(pairs, by, windows, per_year)
    cells = []
    for tag in windows:
        hit = F.col("window") == tag
        for src, out in (("slope", "contracts"), ("r2", "r2"), ("corr", "corr"), ("tstat", "tstat")):
            cells.append(F.max(F.when(hit, F.col(src))).alias(f"{out}_{tag}"))
        cells.append(F.coalesce(F.max(F.when(hit, F.col("n"))), F.lit(0)).alias(f"n_{tag}"))
    return regs.groupBy(*by, "month", "rebalance").agg(*cells)


def walk_forward_leg_betas(pairs: DataFrame, by: Sequence[str], windows: dict[str, int] = WINDOWS,
                           per_year: int = MIN_DAYS_PER_YEAR) -> DataFrame:
    """Per-leg slopes per window; the ratio of any beta is b_linked - beta * b_nominal."""
    regs = window_regressions(pairs, by, windows, per_year)
    cells = []
    for tag in windows:
        hit = F.col("window") == tag
        cells += [F.max(F.when(hit, F.col("l_slope"))).alias(f"b_linked_{tag}"), F.max(F.when(hit, F.col("n_slope"))).alias(f"b_nominal_{tag}"),
                  F.coalesce(F.max(F.when(hit, F.col("rows"))), F.lit(0)).alias(f"n_{tag}")]
    return regs.groupBy(*by, "month", "rebalance").agg(*cells)


def full_sample_betas(pairs: DataFrame, by: Sequence[str], min_rows: int = 1) -> DataFrame:
    """One regression per leg over the whole horizon, and the breakeven's own."""
    x = F.col("x_usd")
    lin, nom, be = (ols_columns(x, F.col(c)) for c in ("linked_usd", "nominal_usd", "be_usd"))
    agg = pairs.groupBy(*by).agg(
        F.count("be_usd").alias("n"), lin[0].alias("b_linked"), nom[0].alias("b_nominal"), be[0].alias("be_beta"), be[2].alias("be_r2"),
        be[4].alias("be_t"), lin[2].alias("out_r2"),
    )
    return agg.where(F.col("n") >= min_rows)


def month_hedge(leg_betas: DataFrame, window: str) -> DataFrame:
    """(tenor, month) leg slopes of one window, in the shape the hedged operators take."""
    return leg_betas.select("tenor", "month", F.col(f"b_linked_{window}").alias("b_linked"), F.col(f"b_nominal_{window}").alias("b_nominal"))


def static_hedge(months: DataFrame, table: dict[str, tuple[float, float]] = FULL_HEDGE) -> DataFrame:
    """The fixed full-sample slopes for every (tenor, month) given."""
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for t, v in table.items() for x in (t, v[i])]), F.col("tenor"))
    return months.select("tenor", "month").distinct().withColumns({"b_linked": pick(0), "b_nominal": pick(1)})


def daily_hedge(returns: DataFrame, hedge: DataFrame, energy: DataFrame, beta: float = 1.0) -> DataFrame:
    """Each day with its month's leg slopes, ratio and zero-filled energy dollars."""
    gas = energy.select("date", F.col("usd_per_contract").alias("gas_usd"))
    days = returns.withColumn("month", month_start(F.col("date"))).join(F.broadcast(hedge), ["tenor", "month"], "left").join(F.broadcast(gas), "date", "left")
    return days.withColumns({"gas_usd": F.coalesce("gas_usd", F.lit(0.0)), "contracts": F.col("b_linked") - beta * F.col("b_nominal")})


def hedged_returns(days: DataFrame) -> DataFrame:
    """Unhedged and hedged breakeven at beta 1 and 0.75 with running sums."""
    h = lambda beta: F.coalesce(F.col("b_linked") - beta * F.col("b_nominal"), F.lit(0.0)) * F.col("gas_usd") / 1e5
    be75 = F.col("r_linked_bp") - 0.75 * F.col("r_nominal_bp")
    out = days.withColumns({"r_be75_bp": be75, "r_be100_hedged_bp": F.col("r_be_bp") - h(1.0), "r_be75_hedged_bp": be75 - h(0.75)})
    w = up_to_now(["tenor"], "date")
    run = lambda c: F.when(F.col(c).isNotNull(), F.sum(c).over(w))
    return out.withColumns({"cum_be100_hedged_bp": run("r_be100_hedged_bp"), "cum_be75_bp": run("r_be75_bp"), "cum_be75_hedged_bp": run("r_be75_hedged_bp")})


def hedge_table(be100: DataFrame, be75: DataFrame) -> DataFrame:
    """Beta 1 and 0.75 ratios with R2 side by side per rebalance month."""
    side = lambda df, tag: df.select("tenor", "month", *[F.col(f"{c}_{w}").alias(f"{tag}_{w}{s}") for w in WINDOWS for c, s in (("contracts", ""), ("r2", "_r2"))])
    counts = be100.select("tenor", "month", *[f"n_{w}" for w in WINDOWS])
    return side(be100, "be100").join(side(be75, "be75"), ["tenor", "month"]).join(counts, ["tenor", "month"])
