"""On-the-run schedules and roll events.

New issues are reduced to one bond per (leg, tenor, issue day) before any window, which bounds
every window and broadcast here by the calendar instead of the number of bonds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.daycount import month_start
from ..functions.ordered import asof
from ..session import unsettled
from . import calendars

MIN_REAL_AUCTION = 1e9  # fixed value: smaller sizes are contingency tests
KEY = ["leg", "tenor"]


def new_issues(auctions: DataFrame) -> DataFrame:
    """First issue of each bond in its leg and tenor."""
    first = F.min(F.struct("issue_date", "auction_date", "maturity_date")).alias("f")
    return auctions.where(F.col("issue_date").isNotNull()).groupBy(*KEY, "bond_id").agg(first).select(*KEY, "bond_id", "f.*")


def issue_date_min(auctions: DataFrame) -> DataFrame:
    return auctions.where(F.col("issue_date").isNotNull()).groupBy("bond_id").agg(F.min("issue_date").alias("issue_date"))


def maturity_first(auctions: DataFrame) -> DataFrame:
    """Maturity of the earliest auction row that states one."""
    return auctions.where(F.col("maturity_date").isNotNull()).groupBy("bond_id").agg(
        F.min_by("maturity_date", F.struct("auction_date", "maturity_date")).alias("maturity_date")
    )


def real_auctions(auctions: DataFrame, min_size: float = MIN_REAL_AUCTION) -> DataFrame:
    """Linked auctions of a real size; an unknown size counts as real."""
    return auctions.where((F.col("leg") == "linked") & (F.col("offering").isNull() | (F.col("offering") >= min_size)))


def latest_per_issue_day(issues: DataFrame) -> DataFrame:
    """One bond per leg, tenor and issue day (largest id among equals)."""
    best = F.max(F.struct("bond_id", "maturity_date")).alias("b")
    return issues.groupBy(*KEY, "issue_date").agg(best).select(*KEY, "issue_date", "b.*")


def otr_schedule(auctions: DataFrame, last_month) -> DataFrame:
    """Per month: the bond of the latest auction strictly before the 1st."""
    daily = auctions.groupBy(*KEY, "auction_date").agg(F.max(F.struct("bond_id", "maturity_date")).alias("b")).select(*KEY, "auction_date", "b.*")
    bounds = daily.groupBy(*KEY).agg(F.min("auction_date").alias("lo"))
    grid = calendars.months_between_bounds(bounds.withColumn("hi", F.lit(last_month).cast("date")), "lo", "hi").select(*KEY, "month")
    right = daily.withColumn("month", F.date_add("auction_date", 1))
    return asof(grid, right, KEY, "month", ["bond_id", "maturity_date", "auction_date"]).where(F.col("bond_id").isNotNull())


def otr_universe(schedule: DataFrame) -> DataFrame:
    return schedule.select("bond_id", *KEY).distinct()


def roll_linked(issues: DataFrame, calendar: DataFrame, cal_id: str = "US") -> DataFrame:
    """Linked rolls: first business day of the month after issue."""
    linked = latest_per_issue_day(issues.where(F.col("leg") == "linked"))
    monthly = linked.withColumn("next_month", F.add_months(month_start(F.col("issue_date")), 1))
    placed = calendars.first_bday_on_or_after(monthly, calendar, "next_month", cal_id, "eff")
    return placed.where(F.col("eff").isNotNull()).select(*KEY, "eff", "issue_date", "bond_id", "maturity_date")


def roll_nominal_boundary(issues: DataFrame, linked_rolls: DataFrame) -> DataFrame:
    """On each linked roll date: the latest-issued nominal at that date."""
    nominal = latest_per_issue_day(issues.where(F.col("leg") == "nominal"))
    boundaries = linked_rolls.select(F.lit("nominal").alias("leg"), "tenor", "eff").distinct()
    right = nominal.withColumn("eff", F.col("issue_date"))
    hit = asof(boundaries, right, KEY, "eff", ["issue_date", "bond_id", "maturity_date"])
    return hit.where(F.col("bond_id").isNotNull()).select(*KEY, "eff", "issue_date", "bond_id", "maturity_date")


def roll_nominal_matched(issues: DataFrame, linked_rolls: DataFrame, tenor: str = "10y", settle=unsettled) -> DataFrame:
    """Each month: the issued nominal nearest in maturity to the on-the-run linked bond.

    The smallest gap on or after the target wins, else the smallest before it; equal gaps go to the
    latest issue. Candidates are kept per (month, maturity), so a month sees one row per maturity
    day and both directions are as-of lookups rather than pairs. ``settle`` lands the month-sized
    steps that are read more than once.
    """
    rolls = collapse_rolls(linked_rolls.where(F.col("tenor") == tenor))
    targets = settle(rolls.groupBy("tenor", month_start(F.col("eff")).alias("month")).agg(
        F.max(F.struct("eff", "maturity_date")).alias("r")
    ).select("tenor", "month", F.col("r.eff").alias("roll_day"), F.col("r.maturity_date").alias("target")))
    pool = latest_per_issue_day(issues.where((F.col("leg") == "nominal") & (F.col("tenor") == tenor)))
    pool = settle(pool.groupBy("tenor", "issue_date", "maturity_date").agg(F.max("bond_id").alias("bond_id")))
    ends = pool.groupBy("tenor").agg(F.max("issue_date").alias("last_issue")).join(
        targets.groupBy("tenor").agg(F.min("month").alias("lo"), F.max("month").alias("last_roll")), "tenor"
    )
    # two month starts past the later of the last roll month and the last issue
    later = F.greatest("last_roll", "last_issue")
    hi = F.add_months(month_start(later), 2)
    grid = calendars.months_between_bounds(ends.withColumn("hi", hi), "lo", "hi").select("tenor", "month")
    held = asof(grid, targets, ["tenor"], "month", ["target"])
    cut = targets.select("tenor", "month", "roll_day")
    months = settle(held.join(cut, ["tenor", "month"], "left").withColumn("cutoff", F.coalesce("roll_day", "month")))
    offered = calendars.months_between_bounds(pool.join(ends.select("tenor", hi.alias("hi")), "tenor"), "issue_date", "hi")
    alive = offered.join(months.select("tenor", "month", "cutoff"), ["tenor", "month"]).where(F.col("issue_date") <= F.col("cutoff"))
    by_maturity = alive.groupBy("tenor", "month", "maturity_date").agg(F.max(F.struct("issue_date", "bond_id")).alias("p"))
    right = settle(by_maturity.select("tenor", "month", F.col("maturity_date").alias("at"), "maturity_date", "p"))
    left = months.withColumn("at", F.col("target"))
    after = asof(left, right, ["tenor", "month"], "at", ["maturity_date", "p"], "forward").withColumnsRenamed({"maturity_date": "m_after", "p": "p_after"})
    both = asof(after, right, ["tenor", "month"], "at", ["maturity_date", "p"], "backward")
    picked = both.withColumns({"pick": F.coalesce("p_after", "p"), "mat": F.coalesce("m_after", "maturity_date")})
    return picked.where(F.col("pick").isNotNull()).select(
        F.lit("nominal").alias("leg"), "tenor", F.col("cutoff").alias("eff"), F.col("pick.issue_date").alias("issue_date"),
        F.col("pick.bond_id").alias("bond_id"), F.col("mat").alias("maturity_date"),
    )


def collapse_rolls(rolls: DataFrame) -> DataFrame:
    """Latest-issued bond per effective day, then consecutive repeats dropped."""
    best = F.max(F.struct("issue_date", "bond_id", "maturity_date")).alias("b")
    daily = rolls.groupBy(*KEY, "eff").agg(best).select(*KEY, "eff", "b.*")
    previous = F.lag("bond_id").over(Window.partitionBy(*KEY).orderBy("eff"))
    return daily.withColumn("__p", previous).where(F.col("__p").isNull() | (F.col("__p") != F.col("bond_id"))).drop("__p")


def roll_schedule(auctions: DataFrame, calendar: DataFrame, matched_tenors=("10y",), cal_id: str = "US", settle=unsettled) -> DataFrame:
    """All roll events of both legs and every tenor.

    The steps below are read several times and hold at most one row per leg, tenor and issue day, so
    ``settle`` may land them.
    """
    issues = settle(latest_per_issue_day(new_issues(auctions)))
    linked = settle(roll_linked(issues, calendar, cal_id))
    collapsed = collapse_rolls(linked)
    boundary = roll_nominal_boundary(issues, collapsed.where(~F.col("tenor").isin(*matched_tenors)))
    events = linked.unionByName(boundary)
    for tenor in matched_tenors:
        events = events.unionByName(roll_nominal_matched(issues, linked, tenor, settle))
    return collapse_rolls(events)


def roll_effective(rolls: DataFrame, issue_days: DataFrame, calendar: DataFrame, cal_id: str = "US") -> DataFrame:
    """Return-effective roll: never before the business day after issue; repeats dropped.

    ``next_eff`` closes each span, so the active bond of a day is an interval lookup.
    """
    first = rolls.select(*KEY, "eff", "bond_id").join(issue_days, "bond_id", "left")
    entry = calendars.next_bday(first, calendar, "issue_date", cal_id, "entry")
    moved = entry.withColumn("eff", F.when(F.col("issue_date").isNotNull(), F.greatest("eff", "entry")).otherwise(F.col("eff")))
    w = Window.partitionBy(*KEY).orderBy("eff", "bond_id")
    kept = moved.withColumn("__p", F.lag("bond_id").over(w)).where(F.col("__p").isNull() | (F.col("__p") != F.col("bond_id")))
    # several events on one day: the last in order is active from then on
    kept = kept.withColumn("next_eff", F.lead("eff").over(w))
    return kept.where(F.col("next_eff").isNull() | (F.col("next_eff") > F.col("eff"))).select(*KEY, "bond_id", "eff", "next_eff")


def active_bond(days: DataFrame, spans: DataFrame) -> DataFrame:
    """Bond active on each day of a (leg, tenor): the latest roll at or before it."""
    right = spans.select(*KEY, F.col("eff").alias("date"), "bond_id")
    return asof(days, right, KEY, "date", ["bond_id"])


def current_otr(rolls: DataFrame) -> DataFrame:
    """Last roll event of each leg and tenor."""
    return rolls.groupBy(*KEY).agg(F.max_by("bond_id", "eff").alias("bond_id"), F.max("eff").alias("eff"))


def otr_levels(quotes: DataFrame, schedule: DataFrame) -> DataFrame:
    """Yield level of the scheduled bond from its month to the next scheduled month."""
    w = Window.partitionBy(*KEY).orderBy("month")
    spans = schedule.select(*KEY, "month", F.coalesce(F.lead("month").over(w), F.add_months("month", 1)).alias("until"), "bond_id")
    return (
        quotes.select("bond_id", "date", "ytm").where(F.col("ytm").isNotNull()).join(F.broadcast(spans), "bond_id")
        .where((F.col("date") >= F.col("month")) & (F.col("date") < F.col("until"))).select(*KEY, "date", "bond_id", "ytm")
    )


def breakeven_yield(levels: DataFrame) -> DataFrame:
    """Nominal minus real yield on days with both."""
    pick = lambda leg: F.max(F.when(F.col("leg") == leg, F.col("ytm")))
    both = levels.groupBy("tenor", "date").agg(pick("linked").alias("real_ytm"), pick("nominal").alias("nominal_ytm"))
    return both.where(F.col("real_ytm").isNotNull() & F.col("nominal_ytm").isNotNull()).withColumn(
        "breakeven", F.col("nominal_ytm") - F.col("real_ytm")
    )


def level_coverage(levels: DataFrame) -> DataFrame:
    return levels.groupBy(*KEY).agg(F.count(F.lit(1)).alias("days"))
