"""Windowed quality measures.

A plain measure is an aggregate Column, so partial aggregation, codegen and use in a
streaming query come for free. Measures that need the frequency of each value, a
group's mean or ranks are ``Staged``: the monitor plans them as a second aggregation
level instead of collecting a group's values. Fractions and means are rounded.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _share(part: Column, precision: int = 3) -> Column:
    return F.round(part / F.count("*"), precision)


# ---- basic -----------------------------------------------------------------
def min(c): return F.min(_c(c))  # noqa: A001, E704
def max(c): return F.max(_c(c))  # noqa: A001, E704
def sum(c): return F.sum(_c(c))  # noqa: A001, E704
def count(c=None): return F.count("*")  # noqa: E704
def count_non_null(c): return F.count(_c(c))  # noqa: E704
def availability(c=None): return F.count("*") > 0  # noqa: E704
def mean(c, precision: int = 3): return F.round(F.avg(_c(c)), precision)  # noqa: E704
def median(c): return F.median(_c(c))  # noqa: E704


# ---- lengths ---------------------------------------------------------------
def _digits(c, part: int) -> Column:
    """Digits of the integer (0) or fractional (1) part; leading zeros do not count, a lone zero is 1."""
    text = F.format_string("%s", F.abs(_c(c)).cast("decimal(38,10)").cast("string"))
    piece = F.split(text, "[.]")[part]
    piece = F.regexp_replace(piece, "0+$", "") if part else piece
    return F.length(F.when(piece == "", "0").otherwise(piece).cast("decimal(38,0)").cast("string"))


def _lengths(expr: Callable) -> dict[str, Callable]:
    return {
        "min": lambda c: F.min(expr(c)), "max": lambda c: F.max(expr(c)),
        "mean": lambda c, precision=3: F.round(F.avg(expr(c)), precision), "median": lambda c: F.median(expr(c)),
    }


_text, _int, _frac = _lengths(lambda c: F.length(_c(c).cast("string"))), _lengths(lambda c: _digits(c, 0)), _lengths(lambda c: _digits(c, 1))
min_length, max_length, mean_length, median_length = _text["min"], _text["max"], _text["mean"], _text["median"]
min_integer_part_length, max_integer_part_length = _int["min"], _int["max"]
mean_integer_part_length, median_integer_part_length = _int["mean"], _int["median"]
min_fractional_part_length, max_fractional_part_length = _frac["min"], _frac["max"]
mean_fractional_part_length, median_fractional_part_length = _frac["mean"], _frac["median"]


# ---- completeness and shape ------------------------------------------------
def missing(c, disguised=None) -> Column:
    col = _c(c)
    out = col.isNull() | (col.cast("string") == "")
    return out | col.isin(list(disguised)) if disguised else out


def missing_count(c, disguised=None): return F.count_if(F.coalesce(missing(c, disguised), F.lit(True)))  # noqa: E704
def missing_fraction(c, disguised=None, precision: int = 3): return _share(missing_count(c, disguised), precision)  # noqa: E704


def is_frozen(c) -> Column:
    text = F.coalesce(_c(c).cast("string"), F.lit("null"))
    return F.min(text) == F.max(text)


def tuple_sorted_by_time(time_column, c) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(_c(time_column).alias("t"), _c(c).alias("v"))))
    return F.transform(pairs, lambda x: x["v"])


def satisfies_ordering(c, time_column, ordering: str = "ASC") -> Column:
    """Whether values never fall (ASC) or rise (DESC) in order of time; an unknown order is ASC."""
    v = tuple_sorted_by_time(time_column, c)
    pairs = F.zip_with(F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, F.lit(2), F.size(v)), lambda a, b: a >= b if ordering.upper() == "DESC" else a <= b)
    return F.coalesce(F.forall(pairs, lambda x: x), F.lit(True))


def window_duration() -> Column: return F.max(F.col("window_end").cast("timestamp").cast("double") - F.col("window_start").cast("timestamp").cast("double"))  # noqa: E704
def ndarray(c): return F.collect_list(_c(c))  # noqa: E704
def tuple(c): return F.transform(F.collect_list(F.struct(_c(c).alias("v"))), lambda x: x["v"])  # noqa: A001, E704
def tuple_sorted(c): return F.array_sort(F.collect_list(_c(c)))  # noqa: E704


# ---- distinctness ----------------------------------------------------------
def distinct_count(c): return F.count_distinct(_c(c)) + F.max(_c(c).isNull().cast("int"))  # noqa: E704
def distinct_fraction(c, precision: int = 3): return _share(distinct_count(c), precision)  # noqa: E704
def distinct_placeholder_count(c, placeholders): return F.count_distinct(F.when(_c(c).isin(list(placeholders)), _c(c)))  # noqa: E704
def distinct_placeholder_fraction(c, placeholders, precision: int = 3): return _share(distinct_placeholder_count(c, placeholders), precision)  # noqa: E704
def distinct_count_approx(c, rsd: float = 0.02): return F.approx_count_distinct(_c(c), rsd)  # noqa: E704
def distinct_fraction_approx(c, precision: int = 3): return _share(distinct_count_approx(c), precision)  # noqa: E704
def most_frequent_approx(c, k: int = 5): return F.expr(f"approx_top_k({c}, {k})")  # noqa: E704


# ---- spread and conformance ------------------------------------------------
def std_dev(c, precision: int = 3, compat: bool = False):
    """Population standard deviation; ``compat`` gives the variance under the same name."""
    return F.round((F.var_pop if compat else F.stddev_pop)(_c(c)), precision)


def variance(c, precision: int = 3): return F.round(F.var_pop(_c(c)), precision)  # noqa: E704


def in_range(c, low, high, inclusive=True) -> Column:
    lo, hi = (inclusive, inclusive) if isinstance(inclusive, bool) else inclusive
    col = _c(c)
    return (col >= low if lo else col > low) & (col <= high if hi else col < high)


def range_conformance_count(c, low, high, inclusive=True): return F.count_if(in_range(c, low, high, inclusive))  # noqa: E704
def range_conformance_fraction(c, low, high, inclusive=True, precision: int = 3): return _share(range_conformance_count(c, low, high, inclusive), precision)  # noqa: E704
def set_conformance_count(c, allowed): return F.count_if(_c(c).isin(list(allowed)))  # noqa: E704
def set_conformance_fraction(c, allowed, precision: int = 3): return _share(set_conformance_count(c, allowed), precision)  # noqa: E704
def regex_conformance_count(c, regex): return F.count_if(_c(c).rlike(f"^(?:{regex})"))  # noqa: E704
def regex_conformance_fraction(c, regex, precision: int = 3): return _share(regex_conformance_count(c, regex), precision)  # noqa: E704


def percentiles(c, points=(25, 50, 75), precision: int = 3) -> Column:
    """Map from point to linearly interpolated percentile; a single number is one point."""
    pts = [points] if isinstance(points, (int, float)) else list(points)
    got = F.percentile(_c(c), F.array(*(F.lit(p / 100) for p in pts)))
    return F.map_from_arrays(F.array(*(F.lit(float(p)) for p in pts)), F.transform(got, lambda x: F.round(x, precision)))


def first_digit_frequencies(c, precision: int = 3) -> Column:
    """Map from leading digit 0-9 to [count, share]."""
    d = F.substring(F.abs(_c(c)).cast("decimal(38,10)").cast("string"), 1, 1)
    n = F.count(_c(c))
    cells = []
    for i in range(10):
        k = F.count_if(d == str(i))
        cells += [F.lit(i), F.array(k.cast("double"), F.round(k / n, precision))]
    return F.create_map(*cells)


def trend(c, time_column, precision: int = 3) -> Column:
    """Least-squares slope of the value over time; 0 for fewer than two points."""
    y, t = _c(c).cast("double"), _c(time_column).cast("double")
    return F.coalesce(F.round(F.regr_slope(y, t), precision), F.lit(0.0))


# documented names without an implementation of their own elsewhere
std, var, pattern_conformance_count, pattern_conformance_fraction = std_dev, variance, regex_conformance_count, regex_conformance_fraction
null_count, missing_percentage = missing_count, missing_fraction
def percentile(c, p, precision: int = 3): return F.round(F.percentile(_c(c), p / 100), precision)  # noqa: E704
def duplicate_count(c): return F.count(_c(c)) - F.count_distinct(_c(c))  # noqa: E704
def error_rate(condition: Column, precision: int = 3): return _share(F.count_if(condition), precision)  # noqa: E704
is_ordered, session_duration = satisfies_ordering, window_duration


# ---- measures with a stage of their own -------------------------------------
@dataclass(frozen=True)
class Staged:
    """``plan(df, keys)`` gives one row per group: the keys and column ``value``."""

    plan: Callable[[DataFrame, list[str]], DataFrame]


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null: a null instance is a group like any other."""
    other = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys))
    return left.join(other, on, how).drop(*(f"_r_{k}" for k in keys))


def _frequencies(final: Callable[[], Column], c) -> Staged:
    def plan(df: DataFrame, keys: list[str]) -> DataFrame:
        freq = df.groupBy(*keys, _c(c).alias("_v")).agg(F.count("*").alias("_n"))
        top = freq.groupBy(*keys).agg(F.max("_n").alias("_top"))
        return null_safe(freq, top, keys).groupBy(*keys).agg(final().alias("value"))

    return Staged(plan)




def _tops() -> Column:
    return F.array_sort(F.collect_list(F.when(F.col("_n") == F.col("_top"), F.col("_v"))))


def most_frequent(c): return _frequencies(_tops, c)  # noqa: E704
def constancy(c): return _frequencies(lambda: F.max("_n"), c)  # noqa: E704
def unique_count(c): return _frequencies(lambda: F.count_if(F.col("_n") == 1), c)  # noqa: E704
def unique_fraction(c, precision: int = 3): return _frequencies(lambda: F.round(F.count_if(F.col("_n") == 1) / F.sum("_n"), precision), c)  # noqa: E704
def unique_over_distinct_fraction(c, precision: int = 3): return _frequencies(lambda: F.round(F.count_if(F.col("_n") == 1) / F.count("*"), precision), c)  # noqa: E704


def _top_where(test: Callable[[Column], Column], share: bool, c, precision: int = 3) -> Staged:
    hits = lambda: F.count_if((F.col("_n") == F.col("_top")) & test(F.col("_v")))
    return _frequencies((lambda: F.round(hits() / F.count_if(F.col("_n") == F.col("_top")), precision)) if share else hits, c)


def range_conformance_count_only_most_frequent(c, low, high, inclusive=True): return _top_where(lambda v: in_range(v, low, high, inclusive), False, c)  # noqa: E704
def range_conformance_fraction_only_most_frequent(c, low, high, inclusive=True, precision: int = 3): return _top_where(lambda v: in_range(v, low, high, inclusive), True, c, precision)  # noqa: E704
def set_conformance_count_only_most_frequent(c, allowed): return _top_where(lambda v: v.isin(list(allowed)), False, c)  # noqa: E704
def set_conformance_fraction_only_most_frequent(c, allowed, precision: int = 3): return _top_where(lambda v: v.isin(list(allowed)), True, c, precision)  # noqa: E704


def _above_mean(final: Callable[[], Column], c) -> Staged:
    def plan(df: DataFrame, keys: list[str]) -> DataFrame:
        means = df.groupBy(*keys).agg(F.avg(_c(c)).alias("_mean"))
        return null_safe(df, means, keys).withColumn("_v", _c(c)).groupBy(*keys).agg(final().alias("value"))

    return Staged(plan)


def above_mean_count(c): return _above_mean(lambda: F.count_if(F.col("_v") > F.col("_mean")), c)  # noqa: E704
def above_mean_fraction(c, precision: int = 3): return _above_mean(lambda: F.round(F.count_if(F.col("_v") > F.col("_mean")) / F.count("*"), precision), c)  # noqa: E704


def _average_rank(keys: list[str], c: str) -> Column:
    by = Window.partitionBy(*keys)
    return F.rank().over(by.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2


def _kendall(pdf, keys, a, b):
    """tau-b of one group from pair concordance counted in O(n log n) by merge ranks."""
    import numpy as np
    import pandas as pd

    x, y = pdf[a].to_numpy(float), pdf[b].to_numpy(float)
    n = len(x)
    order = np.lexsort((y, x))
    ry = np.unique(y[order], return_inverse=True)[1] + 1
    tree, discordant = np.zeros(ry.max(initial=0) + 2, np.int64), 0
    for k, r in enumerate(ry):
        i, below = int(r), 0
        while i > 0:
            below += tree[i]
            i -= i & -i
        discordant += k - below
        i = int(r)
        while i < len(tree):
            tree[i] += 1
            i += i & -i
    ties = lambda v: int((v * (v - 1) // 2).sum())
    tx = ties(np.unique(x, return_counts=True)[1])
    ty = ties(np.unique(y, return_counts=True)[1])
    txy = ties(np.unique(np.stack([x, y], 1), axis=0, return_counts=True)[1]) if n else 0
    pairs = n * (n - 1) // 2
    scale = math.sqrt((pairs - tx) * (pairs - ty))
    tau = (pairs - tx - ty + txy - 2 * discordant) / scale if scale else float("nan")
    return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), tau]], columns=[*keys, "value"])


def correlation(first: str, second: str, precision: int = 3, method: str = "pearson"):
    """pearson (a plain aggregate), spearman, kendall (tau-b) or cramer (V); else ValueError."""
    if method == "pearson":
        return F.round(F.corr(first, second), precision)
    if method not in ("spearman", "kendall", "cramer"):
        raise ValueError(f"unknown correlation method {method!r}")

    def plan(df: DataFrame, keys: list[str]) -> DataFrame:
        both = df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
        if method == "spearman":
            ranked = both.select(*keys, _average_rank(keys, first).alias("_a"), _average_rank(keys, second).alias("_b"))
            return ranked.groupBy(*keys).agg(F.round(F.corr("_a", "_b"), precision).alias("value"))
        if method == "kendall":
            schema = ", ".join(f"{k} {both.schema[k].dataType.simpleString()}" for k in keys) + ", value double"
            got = both.select(*keys, first, second).groupBy(*keys).applyInPandas(lambda pdf: _kendall(pdf, keys, first, second), schema)
            return got.withColumn("value", F.round("value", precision))
        cell = both.groupBy(*keys, first, second).agg(F.count("*").alias("_n"))
        rows = cell.groupBy(*keys, first).agg(F.sum("_n").alias("_r"))
        cols = cell.groupBy(*keys, second).agg(F.sum("_n").alias("_k"))
        total = cell.groupBy(*keys).agg(F.sum("_n").alias("_t"), F.count_distinct(first).alias("_nr"), F.count_distinct(second).alias("_nk"))
        joined = null_safe(null_safe(null_safe(cell, rows, [*keys, first]), cols, [*keys, second]), total, keys)
        phi = F.sum(F.col("_n") * F.col("_n") / (F.col("_r") * F.col("_k"))) - 1
        low = F.least(F.first("_nr"), F.first("_nk")) - 1
        return joined.groupBy(*keys).agg(F.when(low > 0, F.round(F.sqrt(phi / low), precision)).otherwise(F.lit(float("nan"))).alias("value"))

    return Staged(plan)
