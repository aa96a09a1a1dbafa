"""Ordered-series idioms: as-of lookups, running sums, islands.

Every window here partitions by a series key whose rows are unique per day, so a group is never
longer than the calendar (about 260 rows a year), however many raw rows fed that day: callers
aggregate to one row per (key, day) first, with map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ROW = "__row"
_HIT = "__hit"
_SIDE = "__side"


def up_to_now(by: Sequence[str], on: str):
    """Rows from the start of the series to the current one."""
    return Window.partitionBy(*by).orderBy(on).rowsBetween(Window.unboundedPreceding, 0)


def asof(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    on: str,
    values: Sequence[str],
    direction: str = "backward",
    exact: bool = True,
) -> DataFrame:
    """Attach to each left row the latest (or next) right row of the same key.

    ``backward`` takes the last right row at or before ``on``, ``forward`` the first at or after.
    With ``exact=False`` the equal day does not count. One shuffle on ``by``, one sort; no range join.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction must be backward or forward, not {direction!r}")
    backward = direction == "backward"
    right_side = 0 if exact else 2
    tagged_left = left.select(
        *by, on, F.lit(1).alias(_SIDE), F.struct(*left.columns).alias(_ROW),
        F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias(_HIT),
    )
    tagged_right = right.select(
        *by, on, F.lit(right_side).alias(_SIDE),
        F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias(_ROW),
        F.struct(*values).alias(_HIT),
    )
    order = [F.col(on), F.col(_SIDE)] if backward else [F.col(on).desc(), F.col(_SIDE)]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        tagged_left.unionByName(tagged_right)
        .withColumn(_HIT, F.last(_HIT, ignorenulls=True).over(w))
        .where(F.col(_ROW).isNotNull())
        .select(f"{_ROW}.*", *[F.col(f"{_HIT}.{v}").alias(v) for v in values])
    )


def ffill(df: DataFrame, by: Sequence[str], on: str, cols: Sequence[str]) -> DataFrame:
    """Carry the last known value forward inside each series."""
    w = up_to_now(by, on)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def cum_linear(df: DataFrame, by: Sequence[str], on: str, sums: dict[str, str]) -> DataFrame:
    """Running linear sums; a null day stays null and does not break the sum (``{out: source}``)."""
    w = up_to_now(by, on)
    return df.withColumns(
        {out: F.when(F.col(src).isNotNull(), F.sum(src).over(w)) for out, src in sums.items()}
    )


def cum_flat_gap(df: DataFrame, by: Sequence[str], on: str, sums: dict[str, str]) -> DataFrame:
    """Running sums that run flat over gaps: a null day counts as zero and shows the level."""
    w = up_to_now(by, on)
    return df.withColumns(
        {out: F.sum(F.coalesce(F.col(src), F.lit(0.0))).over(w) for out, src in sums.items()}
    )


def session_segments(df: DataFrame, by: Sequence[str], on: str, watch: Sequence[str], out: str = "segment") -> DataFrame:
    """Number the consecutive runs of equal ``watch`` values (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy(on)
    current, previous = F.struct(*watch), F.lag(F.struct(*watch)).over(w)
    turn = F.when(previous.isNull() | ~current.eqNullSafe(previous), 1).otherwise(0)
    return df.withColumn("__turn", turn).withColumn(out, F.sum("__turn").over(up_to_now(by, on))).drop("__turn")


def first_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in a stated order (never an arbitrary duplicate drop).

    Written as ``min`` over an ordered struct so that duplicates combine before the shuffle and a
    key holding most of the rows stays one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = df.select(*keys, F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *rest).alias("__best"))
    return ranked.groupBy(*keys).agg(F.min("__best").alias("__best")).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in rest])


def drawdown(df: DataFrame, by: Sequence[str], on: str, level: str, out: str = "drawdown") -> DataFrame:
    """Running peak minus the level."""
    return df.withColumn(out, F.max(level).over(up_to_now(by, on)) - F.col(level))


def week_ending_friday(d: Column) -> Column:
    """The Friday on or after a date."""
    return F.next_day(F.date_sub(d, 1), "FRI")


def weekly_sample(df: DataFrame, by: Sequence[str], on: str, cols: Sequence[str]) -> DataFrame:
    """Last non-null value of each week ending Friday."""
    return (
        df.groupBy(*by, week_ending_friday(F.col(on)).alias("week"))
        .agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(on))).alias(c) for c in cols])
    )


def rebase_to_start(df: DataFrame, by: Sequence[str], on: str, level: str, start=None, end=None, short: bool = False) -> DataFrame:
    """Level minus its first known value inside the window; a short position shows the mirror."""
    if start is not None:
        df = df.where(F.col(on) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(on) <= F.lit(end).cast("date"))
    base = F.first(level, ignorenulls=True).over(
        Window.partitionBy(*by).orderBy(on).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    moved = F.col(level) - base
    return df.withColumn("rebased", -moved if short else moved)


def tail_rows(df: DataFrame, by: Sequence[str], on: str, k: int) -> DataFrame:
    """The last k rows of each series (a top-k report)."""
    w = Window.partitionBy(*by).orderBy(F.col(on).desc())
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")
