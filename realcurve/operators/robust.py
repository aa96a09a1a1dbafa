"""Robust regression battery over daily (energy, breakeven) pairs.

A group holds one row per day, so its length is bounded by the calendar. Plain moments are grouped
aggregates joined back; the fits that iterate or sort gather a group once (see ``lines``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ols_columns
from .lines import huber_line, median_fit, theil_sen

MOST_PAIRS = 10_000     # groups of no more pairs use all of them, larger ones at least as many
RANSAC_TRIALS = 100
TOP_INFLUENCE = 8
TRIM_SHARES = (0.005, 0.01, 0.025, 0.05)
LARGE_MOVE_PCTS = (50, 75, 90)


def points(pairs: DataFrame, by: Sequence[str], x: str = "x_usd", y: str = "be_usd", years: int | None = None) -> DataFrame:
    """(x, y) rows with both sides known, optionally only each group's trailing years."""
    p = pairs.select(*by, "date", F.col(x).alias("x"), F.col(y).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    if years is None:
        return p
    last = p.groupBy(*by).agg(F.max("date").alias("__last"))
    return p.join(last, list(by)).where(F.col("date") >= F.add_months("__last", -12 * years)).drop("__last")


def fit(p: DataFrame, by: Sequence[str]) -> DataFrame:
    return p.groupBy(*by).agg(*ols_columns(F.col("x"), F.col("y")))


def line_r2(p: DataFrame, lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """1 - SSE/SST of any line (slope, intercept) on the group's points."""
    err = F.col("y") - (F.col("intercept") + F.col("slope") * F.col("x"))
    return p.join(lines, list(by)).groupBy(*by).agg(
        F.first("slope").alias("slope"), F.first("intercept").alias("intercept"),
        F.when(F.regr_syy("y", "y") > 0, 1.0 - F.try_divide(F.sum(err * err), F.regr_syy("y", "y"))).alias("r2"),
    )


def winsor_ols(p: DataFrame, by: Sequence[str], pct: float) -> DataFrame:
    """Clip x and y at the p and 100-p percentiles of the group, then least squares."""
    q = lambda c, s: F.percentile(c, F.lit(s / 100.0))
    edges = p.groupBy(*by).agg(q("x", pct).alias("xl"), q("x", 100 - pct).alias("xh"), q("y", pct).alias("yl"), q("y", 100 - pct).alias("yh"))
    clip = lambda c, lo, hi: F.least(F.greatest(F.col(c), F.col(lo)), F.col(hi)).alias(c)
    return fit(p.join(edges, list(by)).select(*by, clip("x", "xl", "xh"), clip("y", "yl", "yh")), by)


def shuffled_rank(by: Sequence[str]) -> tuple[Column, Window]:
    """A fixed scrambled order of the days, the sampling order of the pairwise methods."""
    day = F.datediff("date", F.lit("1970-01-01"))
    return day, Window.partitionBy(*by).orderBy((day * 7919) % 10007, "date")


def theil_sen_full(p: DataFrame, by: Sequence[str], most: int = MOST_PAIRS) -> DataFrame:
    """Median slope over all pairs of a group with ``most`` pairs or less; a larger one takes each point with as many of the points
    before it in a scrambled order as make ``most`` pairs at least.
    """
    _, w = shuffled_rank(by)
    n, span = F.count(F.lit(1)).over(Window.partitionBy(*by)), F.col("n") - 0.5
    fewest = F.ceil(span - F.sqrt(F.greatest(span * span - 2.0 * most, F.lit(0.0))))  # least k with k n - k (k + 1) / 2 >= most
    ranked = p.select(*by, "x", "y", F.row_number().over(w).alias("rk"), n.alias("n")).withColumn(
        "steps", F.when(F.col("n") * (F.col("n") - 1) / 2 <= most, F.col("n") - 1).otherwise(fewest).cast("int"))
    late = ranked.where(F.least("steps", F.col("rk") - 1) > 0).withColumn("k", F.explode(F.sequence(F.lit(1), F.least("steps", F.col("rk") - 1))))
    late = late.select(*by, "x", "y", (F.col("rk") - F.col("k")).alias("rk"))
    early = ranked.select(*by, "rk", F.col("x").alias("x0"), F.col("y").alias("y0"))
    slope = late.join(early, [*by, "rk"]).where(F.col("x") != F.col("x0")).groupBy(*by).agg(
        F.percentile((F.col("y") - F.col("y0")) / (F.col("x") - F.col("x0")), F.lit(0.5)).alias("slope"), F.count(F.lit(1)).alias("pairs"))
    return p.join(slope, list(by)).groupBy(*by).agg(
        F.first("slope").alias("slope"), F.percentile(F.col("y") - F.col("slope") * F.col("x"), F.lit(0.5)).alias("intercept"), F.first("pairs").alias("pairs"))


def ransac(p: DataFrame, by: Sequence[str], trials: int = RANSAC_TRIALS) -> DataFrame:
    """Consensus line: seeded two-point trials, inliers within the MAD of y, refit on the best trial's inliers."""
    _, w = shuffled_rank(by)
    middle = p.groupBy(*by).agg(F.percentile("y", F.lit(0.5)).alias("mid"), F.count("y").alias("n"))
    spread = p.join(middle, list(by)).groupBy(*by, "n").agg(F.percentile(F.abs(F.col("y") - F.col("mid")), F.lit(0.5)).alias("tol"))
    ranked = p.withColumn("rk", F.row_number().over(w) - 1)
    draws = spread.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    draws = draws.withColumns({"ra": (F.col("trial") * 7919 + 13) % F.col("n"), "rb": (F.col("trial") * 104729 + 57) % F.col("n")})
    end = lambda s: ranked.select(*by, F.col("rk").alias(f"r{s}"), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"))
    models = draws.join(end("a"), [*by, "ra"]).join(end("b"), [*by, "rb"]).where(F.col("xa") != F.col("xb"))
    models = models.withColumn("ms", F.try_divide(F.col("yb") - F.col("ya"), F.col("xb") - F.col("xa"))).withColumn("mi", F.col("ya") - F.col("ms") * F.col("xa"))
    packed = models.groupBy(*by, "tol").agg(F.collect_list(F.struct("trial", "ms", "mi")).alias("models"))  # at most `trials` long
    tried = p.join(packed, list(by)).select(*by, "date", "x", "y", "tol", F.explode("models").alias("m"))
    near = F.abs(F.col("y") - F.col("m.mi") - F.col("m.ms") * F.col("x")) <= F.col("tol")
    votes = tried.where(near).groupBy(*by, F.col("m.trial").alias("trial")).agg(F.count(F.lit(1)).alias("inliers"))
    best = votes.groupBy(*by).agg(F.max_by("trial", F.struct(F.col("inliers"), -F.col("trial"))).alias("trial"), F.max("inliers").alias("inliers"))
    chosen = best.join(models.select(*by, "trial", "tol", "ms", "mi"), [*by, "trial"])
    kept = p.join(chosen, list(by)).where(F.abs(F.col("y") - F.col("mi") - F.col("ms") * F.col("x")) <= F.col("tol"))
    return kept.groupBy(*by, "inliers").agg(*ols_columns(F.col("x"), F.col("y"))[:2]).select(*by, "slope", "intercept", "inliers")


def influence_points(p: DataFrame, by: Sequence[str]) -> DataFrame:
    """Leverage, Cook's distance and externally studentized residual of every day, from group moments."""
    m = p.groupBy(*by).agg(F.count("x").alias("n"), F.regr_avgx("y", "x").alias("mx"), F.regr_avgy("y", "x").alias("my"),
                           F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy"))
    m = m.where((F.col("n") > 3) & (F.col("sxx") > 0)).withColumn("slope", F.col("sxy") / F.col("sxx"))
    m = m.withColumn("sse", F.col("syy") - F.col("slope") * F.col("sxy"))
    d = p.join(m, list(by)).withColumn("dx", F.col("x") - F.col("mx"))
    d = d.withColumns({"h": 1.0 / F.col("n") + F.col("dx") * F.col("dx") / F.col("sxx"), "e": F.col("y") - F.col("my") - F.col("slope") * F.col("dx")})
    loo = 1.0 - F.col("h")
    mse = F.col("sse") / (F.col("n") - 2)
    mse_out = (F.col("sse") - F.try_divide(F.col("e") * F.col("e"), loo)) / (F.col("n") - 3)
    return d.withColumns(
        {
            "cooks_d": F.try_divide(F.col("e") * F.col("e") * F.col("h"), 2.0 * mse * loo * loo),
            "rstudent": F.try_divide(F.col("e"), F.sqrt(mse_out * loo)),
            "hc3": F.try_divide(F.col("dx") * F.col("dx") * F.col("e") * F.col("e"), loo * loo),
        }
    )


def influence(infl: DataFrame, by: Sequence[str]) -> DataFrame:
    """Threshold counts and the heteroskedasticity-robust t of the slope. Mean leverage is 2/n."""
    return infl.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("cooks_d") > 4.0 / F.col("n")).alias("n_cooks"),
        F.count_if(F.abs("rstudent") > 3).alias("n_rstud"), F.count_if(F.col("h") > 6.0 / F.col("n")).alias("n_lev"),
        F.try_divide(F.first("slope") * F.first("sxx"), F.sqrt(F.sum("hc3"))).alias("hc3_t"),
    )


def top_influence(infl: DataFrame, by: Sequence[str], k: int = TOP_INFLUENCE) -> DataFrame:
    """The k most influential days of each group (a top-k report)."""
    w = Window.partitionBy(*by).orderBy(F.desc("cooks_d"), "date")
    return infl.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*by, "rank", "date", "x", "y", "cooks_d")


def trim_top_pct(infl: DataFrame, by: Sequence[str], score: Column, share: float) -> DataFrame:
    """Points left after dropping the top int(n * share) by score."""
    w = Window.partitionBy(*by).orderBy(score.desc(), "date")
    return infl.withColumn("rank", F.row_number().over(w)).where(F.col("rank") > F.floor(F.col("n") * share))


def trim_curve(infl: DataFrame, by: Sequence[str], shares: Sequence[float] = TRIM_SHARES) -> DataFrame:
    """Slope and R2 after each cut, by influence and by residual; all cuts share one ranking."""
    scores = {"cooks": F.col("cooks_d"), "resid": F.abs("rstudent")}
    ranks = {f"rk_{s}": F.row_number().over(Window.partitionBy(*by).orderBy(c.desc(), "date")) for s, c in scores.items()}
    ranked = infl.select(*by, "date", "x", "y", "n", "cooks_d", "rstudent").withColumns(ranks)
    cuts = F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.lit(float(c)).alias("share"), F.col(f"rk_{s}").alias("rk")) for s in scores for c in shares]))
    kept = ranked.select(*by, "x", "y", "n", cuts.alias("c")).select(*by, "x", "y", "n", "c.*").where(F.col("rk") > F.floor(F.col("n") * F.col("share")))
    fitted = kept.groupBy(*by, "score", "share", "n").agg(*ols_columns(F.col("x"), F.col("y"))[0:3:2])
    return fitted.select(*by, "score", "share", F.floor(F.col("n") * F.col("share")).alias("dropped"), "slope", "r2")


def conditional_r2(p: DataFrame, by: Sequence[str], pcts: Sequence[int] = LARGE_MOVE_PCTS) -> DataFrame:
    """Least squares on the days whose move is at or above each percentile of its size."""
    edges = p.groupBy(*by).agg(F.percentile(F.abs("x"), F.array(*[F.lit(q / 100.0) for q in pcts])).alias("e"))
    tagged = p.join(edges, list(by)).select(
        *by, "x", "y", F.explode(F.array(*[F.struct(F.lit(100 - q).alias("top_pct"), F.col("e")[i].alias("edge")) for i, q in enumerate(pcts)])).alias("t")
    ).where(F.abs("x") >= F.col("t.edge"))
    return tagged.groupBy(*by, F.col("t.top_pct").alias("top_pct")).agg(*ols_columns(F.col("x"), F.col("y"))).select(*by, "top_pct", "n", "slope", "r2")


def huber_fit(p: DataFrame, by: Sequence[str]) -> DataFrame:
    """Huber line of each group, until it stands still."""
    return huber_line(p, by).select(*by, "slope", "intercept")


WINSOR_PCTS = (1.0, 2.5)


def treatments(p: DataFrame, by: Sequence[str]) -> DataFrame:
    """``treatment, slope, intercept, r2`` of each group by every estimator.

    Least squares, plain and on winsorized data, have the r2 of the data they saw; the others the share of the raw data's spread that their line takes.
    """
    own = lambda fitted, name: fitted.select(*by, F.lit(name).alias("treatment"), "slope", "intercept", "r2")
    out = own(fit(p, by), "ols")
    for pct in WINSOR_PCTS:
        out = out.unionByName(own(winsor_ols(p, by, pct), f"winsor{pct:g}"))
    found = [line.select(*by, F.lit(name).alias("treatment"), "slope", "intercept") for name, line in
             (("huber", huber_fit(p, by)), ("median", median_fit(p, by)), ("theil_sen", theil_sen(p, by)), ("ransac", ransac(p, by)))]
    lines = found[0]
    for f in found[1:]:
        lines = lines.unionByName(f)
    err = F.col("y") - (F.col("intercept") + F.col("slope") * F.col("x"))
    squares = p.join(lines, list(by)).groupBy(*by, "treatment").agg(
        F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.sum(err * err).alias("sse"), F.regr_syy("y", "y").alias("sst"))
    return out.unionByName(squares.select(*by, "treatment", "slope", "intercept", F.when(F.col("sst") > 0, 1.0 - F.col("sse") / F.col("sst")).alias("r2")))


def outlier_report(pairs: DataFrame, by: Sequence[str], years: int | None = None, min_rows: int = 30) -> DataFrame:
    """One row per group with the battery."""
    p = points(pairs, by, years=years)
    keys = list(by)
    infl = influence_points(p, by)
    base = fit(p, by).where(F.col("n") >= min_rows).select(*by, "n", F.col("slope").alias("ols_beta"), F.col("r2").alias("ols_r2"))
    inf = influence(infl, by).select(*by, "hc3_t", (F.col("n_cooks") / F.col("n") * 100).alias("cooks_pct"))
    hub = huber_fit(p, by).select(*by, F.col("slope").alias("huber_beta"))
    trim = trim_curve(infl, by, (0.01,)).where(F.col("score") == "cooks").select(*by, F.col("r2").alias("r2_trim1pct"))
    big = conditional_r2(p, by, (90,)).select(*by, F.col("r2").alias("r2_top10pct"))
    out = base
    for part in (inf, hub, trim, big):
        out = out.join(part, keys, "left")
    return out
