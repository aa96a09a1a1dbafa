"""Month stepping, coupon grids, tenor labels and weekday rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25

# The labels of the remaining-tenor grid, its centre points and the upper edges.
BUCKETS = ["2y", "5y", "7y", "10y", "12y", "15y", "20y", "25y", "30y", "40y", "50y"]
BUCKET_TARGETS = {"2y": 2.5, "5y": 4.5, "7y": 7.0, "10y": 10.0, "12y": 12.5, "15y": 15.5,
                  "20y": 20.0, "25y": 25.0, "30y": 31.0, "40y": 40.0, "50y": 50.0}
SHORT_EDGES = [(3, "2y"), (5, "5y"), (8, "7y"), (11, "10y"), (13, "12y"), (17, "15y"), (22, "20y"), (27, "25y")]
LONG_EDGES = [(34, "30y"), (44, "40y")]


def month_index(d: Column) -> Column:
    """Months since year zero."""
    return F.year(d) * 12 + F.month(d) - 1


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def shift_months_eom(anchor: Column, months: Column) -> Column:
    """Anchor moved by whole months; a month-end anchor stays at month-end, else the day is clipped."""
    moved = F.add_months(anchor, months)
    return F.when(anchor == F.last_day(anchor), F.last_day(moved)).otherwise(moved)


def years_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier) / F.lit(DAYS_PER_YEAR)


def coupon_step(freq: Column) -> Column:
    """Months between two coupons."""
    return (F.lit(12) / freq).cast("int")


def coupons_after(day: Column, maturity: Column, freq: Column) -> Column:
    """How many grid coupons lie strictly after a day, maturity included.

    Pure month arithmetic, so no schedule array travels with the quotes. Valid for days before maturity.
    """
    step = coupon_step(freq)
    whole = F.floor((month_index(maturity) - month_index(day)) / step).cast("int")
    candidate = shift_months_eom(maturity, -whole * step)
    return F.when(candidate > day, whole + 1).otherwise(whole)


def coupon_back(maturity: Column, freq: Column, steps: Column) -> Column:
    """The coupon date ``steps`` periods before maturity."""
    return shift_months_eom(maturity, -steps * coupon_step(freq))


def pay_dates(maturity: Column, dated: Column, freq: Column) -> Column:
    """Ascending payment dates strictly after the dated date, maturity included."""
    step = coupon_step(freq)
    last_k = F.floor((month_index(maturity) - month_index(dated)) / step).cast("int")
    grid = F.transform(F.sequence(F.lit(0), last_k), lambda k: shift_months_eom(maturity, -k * step))
    return F.array_sort(F.filter(grid, lambda d: d > dated))


def coupon_schedule(maturity: Column, settle: Column, freq: Column) -> tuple[Column, Column]:
    """(last coupon at or before settle, coupons after it) on the regular grid."""
    left = coupons_after(settle, maturity, freq)
    previous = coupon_back(maturity, freq, left)
    future = F.array_sort(
        F.transform(F.sequence(F.lit(0), left - 1), lambda k: coupon_back(maturity, freq, k.cast("int")))
    )
    return previous, future


def bucket_label(years: Column, long_end: Column | None = None) -> Column:
    """Remaining years to a grid label; half years round to even; under 1.5 years there is none."""
    r = F.bround(years, 0)
    label = F.when(years.isNull() | F.isnan(years) | (years < 1.5), F.lit(None).cast("string"))
    for edge, name in SHORT_EDGES:
        label = label.when(r <= edge, name)
    if long_end is None:
        return label.otherwise("30y")
    label = label.when(~long_end, "30y")
    for edge, name in LONG_EDGES:
        label = label.when(r <= edge, name)
    return label.otherwise("50y")


def nth_weekday(month: Column, weekday: str, nth: int) -> Column:
    """The n-th given weekday (e.g. ``TUE``) of a month, null if the month has none."""
    day = F.date_add(F.next_day(F.date_sub(month_start(month), 1), weekday), 7 * (nth - 1))
    return F.when(month_start(day) == month_start(month), day)
