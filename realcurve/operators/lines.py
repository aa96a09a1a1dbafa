"""Robust lines through the (x, y) rows of each group, solved and not approximated by a fixed number of passes.

A group holds one row per day, so its length is bounded by the calendar, and each fit gathers it once: one shuffle. Huber's line is a fold over the
group's array. The least-absolute line walks along the vertices of its linear programme, and the median slope is selected by counting inversions:
both need sorting and searching within the group, which runs as numpy in the group's task.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

HUBER_T = 1.345  # fixed values: tuning constant, normal consistency of the MAD
MAD_SCALE = 0.6744897501960817
#: Huber's line stops when neither coefficient moves by more than this share of the spread; no more rounds than this are tried.
TOLERANCE, MOST_ROUNDS = 1e-11, 200


# ------------------------------------------------------------------ Huber


def _let(value: Column, use) -> Column:
    """``use(value)``, the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _middle(values: Column) -> Column:
    """Median of an array."""
    s = F.sort_array(values)
    return _let(s, lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2.0)


def _sum(array: Column, term) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, q: s + term(q))


def huber_line(p: DataFrame, by: Sequence[str], tolerance: float = TOLERANCE, rounds: int = MOST_ROUNDS) -> DataFrame:
    """``slope, intercept, rounds, settled``: reweighted least squares, the scale of each round the MAD about zero, until the line stands still.

    Groups without spread in x have a null slope. ``settled`` is false where ``rounds`` didn't do (a line that goes back and forth).
    """
    points = p.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("date", "x", "y"))).alias("__p"))  # a row a day: bounded by the calendar
    pts = F.col("__p")

    def line(weighted: Column) -> Column:
        """Weighted least squares of an array of (x, y, w)."""
        sw = _let(_sum(weighted, lambda q: q["w"]), lambda w: F.struct(w.alias("w"), (_sum(weighted, lambda q: q["w"] * q["x"]) / w).alias("mx"), (_sum(weighted, lambda q: q["w"] * q["y"]) / w).alias("my")))

        def solved(m: Column) -> Column:
            xy = _sum(weighted, lambda q: q["w"] * (q["x"] - m["mx"]) * (q["y"] - m["my"]))
            xx = _sum(weighted, lambda q: q["w"] * (q["x"] - m["mx"]) * (q["x"] - m["mx"]))
            return _let(F.try_divide(xy, xx), lambda b: F.struct(b.alias("b"), (m["my"] - b * m["mx"]).alias("a")))

        return _let(sw, solved)

    def weigh(s: Column, limit: Column) -> Column:
        def one(q: Column) -> Column:
            r = F.abs(q["y"] - s["a"] - s["b"] * q["x"])
            return F.struct(q["x"].alias("x"), q["y"].alias("y"), F.when(r <= limit, F.lit(1.0)).otherwise(F.try_divide(limit, r)).alias("w"))

        return F.transform(pts, one)

    def again(s: Column, _: Column) -> Column:
        scale = _middle(F.transform(pts, lambda q: F.abs(q["y"] - s["a"] - s["b"] * q["x"]))) / MAD_SCALE
        # half of the points on the line: it is settled
        fresh = _let(scale, lambda c: F.when(c > 0, _let(weigh(s, HUBER_T * c), line)).otherwise(F.struct(s["b"].alias("b"), s["a"].alias("a"))))
        near = lambda n, k, size: F.abs(n[k] - s[k]) <= tolerance * size

        def step(n: Column) -> Column:
            still = near(n, "b", F.abs(n["b"]) + F.col("__sy") / F.col("__sx")) & near(n, "a", F.abs(n["a"]) + F.col("__sy"))
            return F.struct(n["b"].alias("b"), n["a"].alias("a"), (s["n"] + 1).alias("n"), F.coalesce(still, F.lit(True)).alias("done"))

        return F.when(s["done"], s).otherwise(_let(fresh, step))

    spread = lambda k: _let(_sum(pts, lambda q: q[k]) / F.size(pts), lambda m: F.sqrt(_sum(pts, lambda q: (q[k] - m) * (q[k] - m)) / F.size(pts)))
    first = F.transform(pts, lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), F.lit(1.0).alias("w")))
    start = _let(first, line)
    ready = points.withColumns({"__sx": spread("x"), "__sy": spread("y"), "__l": start})
    begun = F.struct(F.col("__l.b").alias("b"), F.col("__l.a").alias("a"), F.lit(0).alias("n"), (F.col("__l.b").isNull() | (F.col("__sx") == 0)).alias("done"))
    ended = ready.withColumn("__e", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begun, again))
    return ended.select(*by, F.col("__e.b").alias("slope"), F.col("__e.a").alias("intercept"), F.col("__e.n").alias("rounds"), F.col("__e.done").alias("settled"))


# ------------------------------------------------------------------ least absolute deviations


def _through(x: np.ndarray, y: np.ndarray, i: int) -> tuple[float, int]:
    """The slope of the best line through point ``i``, and the point that it goes on to: a weighted median of slopes."""
    dx = x - x[i]
    far = np.flatnonzero(dx)
    if not len(far):
        return 0.0, i
    slopes, weights = (y[far] - y[i]) / dx[far], np.abs(dx[far])
    order = np.argsort(slopes, kind="stable")
    at = np.searchsorted(np.cumsum(weights[order]), weights.sum() / 2)
    k = order[min(at, len(order) - 1)]
    return float(slopes[k]), int(far[k])


def least_absolute(x: np.ndarray, y: np.ndarray, eps: float = 1e-14) -> tuple[float, float, float]:
    """Slope, intercept and loss of a line with the least sum of absolute residuals; a turn that gains no more than the share ``eps`` of the loss ends the search.

    An optimal line goes through two points. From a line through one, turning it to the weighted median never loses; turned about every point that it
    touches without gain it is optimal, as the loss is convex and linear between such turns.
    """
    i = int(np.argsort(y, kind="stable")[(len(y) - 1) // 2])
    b, j = _through(x, y, i)
    loss = float(np.abs(y - y[i] - b * (x - x[i])).sum())
    while True:
        residual = np.abs(y - y[i] - b * (x - x[i]))
        touched = np.flatnonzero(residual <= 1e-12 * (np.abs(y).max() + np.abs(b * x).max() + 1e-300))
        best = None
        for k in dict.fromkeys([j, i, *touched.tolist()]):
            turned, to = _through(x, y, k)
            found = float(np.abs(y - y[k] - turned * (x - x[k])).sum())
            if found < loss * (1 - eps) and (best is None or found < best[0]):
                best = (found, turned, k, to)
        if best is None:
            return b, float(y[i] - b * x[i]), loss
        loss, b, i, j = best


# ------------------------------------------------------------------ median of pairwise slopes


def inversions(rank: np.ndarray) -> int:
    """Pairs ``i < j`` with ``rank[i] > rank[j]`` of a permutation: by bits, each once where two ranks part."""
    n, total, order = len(rank), 0, rank.astype(np.int64)
    for bit in reversed(range(max(n - 1, 1).bit_length())):
        group, one = order >> (bit + 1), (order >> bit) & 1
        ones = np.cumsum(one)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        before = np.r_[0, ones][starts]
        size = np.diff(np.r_[starts, n])
        total += int(((ones - np.repeat(before, size)) * (1 - one)).sum())
        order = order[np.lexsort((np.arange(n), one, group))]
    return total


def _turned(x: np.ndarray, y: np.ndarray, m: float) -> np.ndarray:
    """The order of the points, left to right, by height over a line of slope ``m``; ``x`` ascends. A pair is turned where its slope is ``m`` or less."""
    z = y - m * x
    # points of one x don't form a pair: within them heights ascend; of equal heights the right one counts as lower
    order = np.lexsort((-np.arange(len(x)), z))
    rank = np.empty(len(x), np.int64)
    rank[order] = np.arange(len(x))
    return rank


def _within(groups: np.ndarray, rank: np.ndarray) -> int:
    """Turned pairs that stand within one x."""
    return sum(inversions(np.argsort(np.argsort(part))) for part in np.split(rank, groups) if len(part) > 1)


def _at_most(x: np.ndarray, y: np.ndarray, groups: np.ndarray, m: float) -> int:
    rank = _turned(x, y, m)
    return inversions(rank) - (_within(groups, rank) if len(groups) + 1 < len(x) else 0)


def _between(x: np.ndarray, y: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Slopes of the pairs that are turned at ``hi`` and not at ``lo``: inversions of one order in the other, listed by merging."""
    first, last = _turned(x, y, lo), _turned(x, y, hi)
    by_first = np.argsort(first)
    rank, out, n = last[by_first], [], len(x)
    blocks = [np.arange(k, k + 1) for k in range(n)]
    while len(blocks) > 1:
        merged = []
        for left, right in zip(blocks[::2], blocks[1::2]):
            held = rank[left]  # ascending
            at = np.searchsorted(held, rank[right])
            count = len(left) - at
            if count.any():
                i = np.repeat(right, count)
                k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at, count)
                p, q = by_first[left[k]], by_first[i]
                apart = x[p] != x[q]
                out.append((y[p[apart]] - y[q[apart]]) / (x[p[apart]] - x[q[apart]]))
            both = np.concatenate((left, right))
            merged.append(both[np.argsort(rank[both], kind="stable")])
        blocks = merged + ([blocks[-1]] if len(blocks) % 2 else [])
    return np.sort(np.concatenate(out)) if out else np.zeros(0)


def _as_number(v: float) -> int:
    """Floats in their order as whole numbers."""
    bits = int(np.float64(v).view(np.int64))
    return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF)


def _as_float(k: int) -> float:
    return float(np.int64(k if k >= 0 else -k).view(np.float64)) * (1 if k >= 0 else -1)


def slope_of_rank(x: np.ndarray, y: np.ndarray, ranks: Sequence[int]) -> list[float]:
    """The slopes of these ranks (from 0) among those of all pairs with different x, without listing the pairs.

    Bisection over the floats in their order, at most 64 rounds of ``n log n``, until few enough pairs are left to list.
    """
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    groups = np.flatnonzero(np.diff(x)) + 1
    out = []
    for rank in ranks:
        top = np.finfo(np.float64).max / 4 / max(1.0, float(np.abs(x).max()))
        lo, hi, below, upto = _as_number(-top), _as_number(top), 0, None
        while hi - lo > 1 and (upto is None or upto - below > 4 * len(x)):
            mid = (lo + hi) // 2
            n = _at_most(x, y, groups, _as_float(mid))
            if n > rank:
                hi, upto = mid, n
            else:
                lo, below = mid, n
        left = _between(x, y, _as_float(lo), _as_float(hi))
        out.append(float(left[min(rank - below, len(left) - 1)]) if len(left) else _as_float(hi))
    return out


def median_slope(x: np.ndarray, y: np.ndarray) -> tuple[float | None, float | None, int]:
    """Median of the slopes of all pairs with different x, the median of what is left over it, and the number of pairs."""
    _, same = np.unique(x, return_counts=True)
    pairs = len(x) * (len(x) - 1) // 2 - int((same * (same - 1) // 2).sum())
    if not pairs:
        return None, None, 0
    b = float(np.mean(slope_of_rank(x, y, sorted({(pairs - 1) // 2, pairs // 2}))))
    return b, float(np.median(y - b * x)), pairs


# ------------------------------------------------------------------ by group


def _by_group(p: DataFrame, by: Sequence[str], columns: str, fit) -> DataFrame:
    """``fit(x, y)`` of every group, as ``columns``."""
    keys = list(by)
    names = [c.split()[0] for c in columns.split(", ")]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.select(*keys).schema)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date", kind="stable")
        found = fit(rows["x"].to_numpy(np.float64), rows["y"].to_numpy(np.float64))
        return pd.DataFrame([[*rows[keys].iloc[0], *found]], columns=[*keys, *names])

    return p.select(*keys, "date", "x", "y").groupBy(*keys).applyInPandas(run, f"{kind}, {columns}")


def median_fit(p: DataFrame, by: Sequence[str], eps: float = 1e-14) -> DataFrame:
    """``slope, intercept, loss`` of the least-absolute line of each group (see ``least_absolute``); null slope where x has no spread."""

    def fit(x: np.ndarray, y: np.ndarray):
        if (x == x[0]).all():
            return None, None, float(np.abs(y - np.median(y)).sum())
        return least_absolute(x, y, eps)

    return _by_group(p, by, "slope double, intercept double, loss double", fit)


def theil_sen(p: DataFrame, by: Sequence[str]) -> DataFrame:
    """``slope, intercept, pairs``: the median slope over all pairs of each group, exactly and at every size."""
    return _by_group(p, by, "slope double, intercept double, pairs long", median_slope)
