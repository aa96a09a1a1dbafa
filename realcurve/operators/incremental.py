"""Top-up of landed quotes, and what it takes to carry it into the returns.

A revised quote changes its bond's returns from its own day on and no other bond's. The sizing of a month rests on the month's first mark, so
a bond is walked again from the start of the month of its first changed day. What the walk needs from before is one row, the bond's last mark and
running sum of an earlier month; such marks are kept by bond and month.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.daycount import month_start
from ..functions.ordered import up_to_now
from ..sources.landed import active
from .walk import RETURN_COLUMNS, epoch_denom, lag_mark, return_terms, steps, usable

OVERLAP_DAYS = 7  # fixed value: how far back a top-up reaches


def topup_merge(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("bond_id", "date")) -> DataFrame:
    """New cells win where known, old rows and extra columns stay."""
    n = new.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in new.columns if c not in keys])
    fields = list(dict.fromkeys([c for c in (*old.columns, *new.columns) if c not in keys]))
    side = lambda c: [F.col(f"__n_{c}")] * (c in new.columns) + [F.col(c)] * (c in old.columns)
    return old.join(n, list(keys), "full").select(*keys, *[F.coalesce(*side(c)).alias(c) for c in fields])


def topup_start(quotes: DataFrame, bonds: DataFrame, as_of: Column, idle: DataFrame) -> DataFrame:
    """First day to fetch again per live, active bond: last known day less the overlap."""
    live = active(bonds, idle).where(F.col("maturity") > as_of).select("bond_id")
    last = quotes.groupBy("bond_id").agg(F.max("date").alias("last_date"))
    return last.join(live, "bond_id", "left_semi").withColumn("start", F.date_sub("last_date", OVERLAP_DAYS))


def missing_ids(universe: DataFrame, quotes: DataFrame) -> DataFrame:
    """Universe ids without any data."""
    return universe.select("bond_id").join(quotes.select("bond_id"), "bond_id", "left_anti")


def apply_overrides(series: DataFrame, overrides: DataFrame) -> DataFrame:
    """Insert or replace the given (series, date) cells. Overrides are a short hand-kept list."""
    kept = series.join(overrides.select("series_id", "date"), ["series_id", "date"], "left_anti")
    return kept.unionByName(overrides.select(*series.columns))


VERSION = ["ts", "event_id"]
MARK = ["settle", "V", "dv01", "n_left"]


def newest_cells(rows: DataFrame, keys: Sequence[str], values: Sequence[str], version: Sequence[str] = VERSION, more: Sequence[Column] = ()) -> DataFrame:
    """One row per key: of each value the newest known, the newest version, and ``more`` aggregates. A row without a version is older than all with one.

    Associative, so it merges a batch with itself, with what is landed, and again with the same batch, to the same table.
    """
    v = F.struct(*[F.col(c).alias(c) for c in version])
    known = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*version))).alias(c)
    found = rows.groupBy(*keys).agg(*[known(c) for c in values], F.max(v).alias("__v"), *more)
    return found.select(*[c for c in found.columns if c != "__v"], *[F.col(f"__v.{c}").alias(c) for c in version])


def merged_cells(old: DataFrame, fresh: DataFrame, keys: Sequence[str], values: Sequence[str], by: str) -> DataFrame:
    """``newest_cells`` of both, and ``changed``: whether a value differs from the old row's. One shuffle by ``by``, one of the keys."""
    both = old.withColumn("__old", F.struct(*values)).unionByName(fresh, allowMissingColumns=True).repartition(by)
    was = F.first("__old", ignorenulls=True).alias("__was")  # keys are unique in ``old``
    merged = newest_cells(both, keys, values, more=[was])
    return merged.withColumn("changed", ~F.struct(*values).eqNullSafe(F.col("__was"))).drop("__was")


def dirty_bonds(merged: DataFrame) -> DataFrame:
    """``bond_id, from_month``: bonds with a changed value, and the month of the first such day."""
    return merged.where("changed").groupBy("bond_id").agg(month_start(F.min("date")).alias("from_month"))


def month_marks(metrics: DataFrame, returns: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """``bond_id, month, date``, the last mark of each bond and month, and its running sum so far (``seeds`` holds the sum from before)."""
    last = metrics.groupBy("bond_id", month_start(F.col("date")).alias("month")).agg(F.max(F.struct("date", *MARK)).alias("m"))
    level = returns.groupBy("bond_id", month_start(F.col("date")).alias("month")).agg(F.max_by("cum_bp", "date").alias("__cum"))
    rows = last.join(level, ["bond_id", "month"], "left").select("bond_id", "month", "m.*", "__cum")
    if seeds is not None:
        rows = rows.unionByName(seeds.select("bond_id", "month", "date", *MARK, F.col("cum_bp").alias("__cum")))
    return rows.withColumn("cum_bp", F.last("__cum", ignorenulls=True).over(up_to_now(["bond_id"], "month"))).drop("__cum")


def seeds_of(marks: DataFrame, dirty: DataFrame) -> DataFrame:
    """The last mark of each dirty bond before its ``from_month``; none where its history starts there."""
    earlier = marks.join(dirty, "bond_id").where(F.col("month") < F.col("from_month"))
    return earlier.groupBy("bond_id").agg(F.max(F.struct("month", "date", *MARK, "cum_bp")).alias("m")).select("bond_id", "m.*")


#: What a walked row is kept as. ``counts``: it has a return; ``closes``: it is the last mark of its bond and month. ``cum_bp`` runs on over rows without one.
WALKED = ["bond_id", "date", "settle", "clean", "ytm", "accrued", "index_ratio", "vendor_ir", "V_prev", "dv01", "denom", "coupon_cash", "days", "gc", "n_left", "cum_bp", "counts", "closes"]
SEED = ["date", *MARK, "cum_bp"]


def seeded(tail: DataFrame, seeds: DataFrame, part: str) -> DataFrame:
    """Quotes with the ``seed`` of their bond (null without), shuffled once, by ``part``, which both have, and sorted by bond and day."""
    mark = seeds.select(part, "bond_id", "date", F.struct(*SEED).alias("seed"))
    rows = tail.unionByName(mark, allowMissingColumns=True).withColumn("__mark", F.col("seed").isNotNull()).repartition(part)
    held = F.last("seed", ignorenulls=True).over(up_to_now([part, "bond_id"], "date"))  # a seed is older than the tail
    return rows.withColumn("seed", held).where(~F.col("__mark")).drop("__mark")


def walk_tail(metrics: DataFrame, part: str) -> DataFrame:
    """The walk of ``metrics`` (whole months of a bond, each row with its ``seed``) gone on with from the seeds, all marks kept as ``WALKED``.

    The same rows, digit by digit, as a walk of all: the running sum starts with the sum before as its first term, in the order of the days as ever.
    Windows by ``part`` and bond keep the rows where a shuffle by ``part`` has put them.
    """
    by = [part, "bond_id"]
    so_far = up_to_now(by, "date")
    sized = steps(epoch_denom(lag_mark(metrics, by, "seed"), by))
    rows = return_terms(sized.withColumn("counts", F.coalesce(usable(sized), F.lit(False))))
    bp = F.when(F.col("counts"), F.col("bp"))
    opens = bp.isNotNull() & (F.count(bp).over(so_far) == 1)
    first = F.when(opens & F.col("seed.cum_bp").isNotNull(), F.col("seed.cum_bp") + bp).otherwise(bp)
    following = F.lead("date").over(Window.partitionBy(*by).orderBy("date"))
    rows = rows.withColumn("__first", first).withColumns({
        "cum_bp": F.coalesce(F.sum("__first").over(so_far), F.col("seed.cum_bp")),
        "closes": following.isNull() | (month_start(following) != month_start(F.col("date")))})
    return rows.select(part, *WALKED)


def values_of(walked: DataFrame) -> DataFrame:
    """Walked rows with the values that are not kept, because they follow from a row's own."""
    return walked.withColumn("dirty_real", F.col("clean") + F.col("accrued")).withColumn("V", F.col("dirty_real") * F.col("index_ratio"))


def returns_of(walked: DataFrame) -> DataFrame:
    """The returns, as ``bond_walk`` gives them."""
    return return_terms(values_of(walked.where("counts"))).select(*RETURN_COLUMNS)


def marks_of(walked: DataFrame) -> DataFrame:
    """The marks of each bond and month, as ``month_marks`` gives them, and their part."""
    rest = [c for c in walked.columns if c not in WALKED]
    return values_of(walked.where("closes")).select("bond_id", month_start(F.col("date")).alias("month"), "date", *MARK, "cum_bp", *rest)


def outside(table: DataFrame, dirty: DataFrame, day: str) -> DataFrame:
    """Rows that a recomputation leaves: of other bonds, and of earlier months."""
    return table.join(dirty, "bond_id", "left").where(F.col("from_month").isNull() | (F.col(day) < F.col("from_month"))).drop("from_month")
