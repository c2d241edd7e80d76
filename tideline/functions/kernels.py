"""Expressions with the null rules of the data model: null is undefined, aggregates skip it, nothing makes a NaN."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def rolling(agg: Callable[[Column], Column], value: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """agg over the last n rows, null with fewer than `least` (n) values that are not null."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) >= (n if least is None else least), agg(value).over(frame))


def clip(x: Column, low: float | None, high: float | None) -> Column:
    """x held within bounds; null stays null, which greatest() and least() alone don't do."""
    y = x if high is None else F.least(F.lit(float(high)), x)
    y = y if low is None else F.greatest(F.lit(float(low)), y)
    return F.when(x.isNotNull(), y)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def flag(condition: Column) -> Column:
    """1.0 or 0.0; an undefined comparison is false."""
    return F.when(F.coalesce(condition, F.lit(False)), 1.0).otherwise(0.0)


def pct_rank(value: Column, *keys: str) -> Column:
    """Rank over the count of values, ties at their mean, within keys; null for null."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(value.asc_nulls_last())
    same = W.partitionBy(*keys, value)
    return F.when(value.isNotNull(), (F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2) / F.count(value).over(W.partitionBy(*keys)))


def window_rank_pct(value: Column, w: WindowSpec, n: int, least: int) -> Column:
    """Mean-tie rank of the current value among the last n, over their count."""
    frame = w.rowsBetween(-(n - 1), 0)
    seen = F.collect_list(value).over(frame)
    below, same = (F.size(F.filter(seen, f)) for f in (lambda v: v < value, lambda v: v == value))
    return F.when(value.isNotNull() & (F.count(value).over(frame) >= least), (below + (same + 1) / 2) / F.size(seen))


def rolling_rank(values: np.ndarray, n: int, least: int) -> np.ndarray:
    """Mean-tie rank of each value among the last n, over their count, NaN being undefined: one pass over an ordered window."""
    out, window = np.full(len(values), np.nan), []
    for i, x in enumerate(values):
        if i >= n and (old := values[i - n]) == old:
            del window[bisect_left(window, old)]
        if x == x:
            insort(window, x)
            if len(window) >= least:
                out[i] = (bisect_left(window, x) + bisect_right(window, x) + 1) / 2 / len(window)
    return out


def weighted_mean(columns: Iterable[tuple[str, Column | float]]) -> Column:
    """Mean of the columns that are not null, by weight; null if the weights left sum to 0."""
    top = bottom = F.lit(0.0)
    for name, weight in columns:
        weight = weight if isinstance(weight, Column) else F.lit(float(weight))
        top = top + F.coalesce(F.col(name) * weight, F.lit(0.0))
        bottom = bottom + F.when(F.col(name).isNotNull(), weight).otherwise(0.0)
    return F.try_divide(top, bottom)


def zscore(value: Column, *keys: str, bound: float = 3.0) -> Column:
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys)
    return clip(ratio(value - F.avg(value).over(w), F.stddev_samp(value).over(w)), -bound, bound)


def guarded_corr(a: str, b: str) -> Column:
    """Pearson correlation as a group aggregate over pairs that are both there; null for a constant."""
    x, y = (F.when(F.col(p).isNotNull() & F.col(q).isNotNull(), F.col(p)) for p, q in ((a, b), (b, a)))
    return ratio(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
