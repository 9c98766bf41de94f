"""Rolling, lagged, exponentially weighted and ranked columns over the rows of one entity.

A rolling value is null unless its window holds n rows with a value. Division by zero gives null.
All windows share one partitioning by entity, so a plan over them has one exchange.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12
#: The greatest logarithm of a product within a block of an exponential mean, far from overflow.
EXPONENT = 300.0


def fresh(df: DataFrame, name: str) -> str:
    """A prefix that no column of df has, compared without case."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = "_" + name
    return name


def rows(key: str = "ticker", order: str = "date"):
    return Window.partitionBy(key).orderBy(order)


def last_n(n: int, w=None):
    return (w or rows()).rowsBetween(1 - n, 0)


def full(x: Column, n: int, value: Column, w=None) -> Column:
    """value where all of the last n rows have x."""
    return F.when(F.count(x).over(last_n(n, w)) == n, value)


def mean(x: Column, n: int, w=None) -> Column:
    return full(x, n, F.avg(x).over(last_n(n, w)), w)


def std(x: Column, n: int, ddof: int = 1, w=None) -> Column:
    return full(x, n, (F.stddev_samp(x) if ddof else F.stddev_pop(x)).over(last_n(n, w)), w)


def lowest(x: Column, n: int, w=None) -> Column:
    return full(x, n, F.min(x).over(last_n(n, w)), w)


def highest(x: Column, n: int, w=None) -> Column:
    return full(x, n, F.max(x).over(last_n(n, w)), w)


def skew(x: Column, n: int, w=None) -> Column:
    """Bias-corrected skewness; 0 for a constant window."""
    flat = highest(x, n, w) == lowest(x, n, w)
    scaled = F.skewness(x).over(last_n(n, w)) * F.lit((n * (n - 1)) ** 0.5 / (n - 2))
    return full(x, n, F.when(flat, 0.0).otherwise(scaled), w)


def kurt(x: Column, n: int, w=None) -> Column:
    """Bias-corrected excess kurtosis; -3 for a constant window."""
    flat = highest(x, n, w) == lowest(x, n, w)
    scaled = (F.kurtosis(x).over(last_n(n, w)) * (n + 1) + 6) * F.lit((n - 1) / ((n - 2) * (n - 3)))
    return full(x, n, F.when(flat, -3.0).otherwise(scaled), w)


def corr_of(x: Column, y: Column, over=lambda c: c) -> Column:
    """Pearson correlation of the pairs without nulls; null where one side is constant."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(over(F.covar_pop(x, y)), over(F.stddev_pop(x)) * over(F.stddev_pop(y)))


def corr(x: Column, y: Column, n: int, w=None) -> Column:
    return full(F.when(y.isNotNull(), x), n, corr_of(x, y, lambda c: c.over(last_n(n, w))), w)


def change(x: Column, n: int = 1, w=None) -> Column:
    return F.try_divide(x, F.lag(x, n).over(w or rows())) - 1


def average_rank(x: Column, *by: str) -> Column:
    """Ascending rank within by, ties sharing their mean rank."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2


@dataclass(frozen=True)
class Ewm:
    """An exponentially weighted mean: out from x, recursive, null before least observations."""

    out: str
    x: str
    alpha: float
    least: int


def ewm(df: DataFrame, specs: Sequence[Ewm], key: str = "ticker", order: str = "date") -> DataFrame:
    """Adds each spec's mean. Rows without x repeat the mean, and age it by one step.

    y = k * y_before + l * x with k = (1 - a)^g / ((1 - a)^g + a) and l = 1 - k, g rows since the last
    observation; k is carried as a logarithm, so that no gap is too long. All specs share blocks of
    rows, short enough that no product within one overflows at the greatest alpha: within a block the
    recursion is a sum over products, and the blocks are chained by a short fold.
    """
    w = rows(key, order)
    before, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    names = list(df.columns) + [s.out for s in specs]
    decay = {s: math.log1p(-s.alpha) for s in specs}
    size = max(1, int(EXPONENT / max(-d for d in decay.values())))
    tag = fresh(df, "_ewm")
    t = lambda kind, s: f"{tag}_{kind}_{s.out}"
    row, block = f"{tag}_row", f"{tag}_block"
    seen = {s: F.col(s.x).isNotNull() for s in specs}
    df = df.withColumn(row, F.row_number().over(w)).withColumn(block, F.floor((F.col(row) - 1) / size))
    df = df.withColumns(
        {t("n", s): F.count(s.x).over(so_far) for s in specs} | {t("at", s): F.last(F.when(seen[s], F.col(row)), True).over(before) for s in specs}
    )
    age = lambda s: (F.col(row) - F.col(t("at", s))) * decay[s]
    opens = lambda s: F.col(t("at", s)).isNull() | (F.col(t("at", s)) <= F.col(block) * size)
    step = lambda s: age(s) - F.ln(F.exp(age(s)) + s.alpha)
    df = df.withColumns(
        {t("l", s): F.when(seen[s], F.coalesce(s.alpha / (F.exp(age(s)) + s.alpha), F.lit(1.0))) for s in specs}
        # What the first observation of a block does to the mean that comes into it is kept apart.
        | {t("k", s): F.when(seen[s] & ~opens(s), step(s)).otherwise(0.0) for s in specs}
        | {t("e", s): F.when(seen[s] & opens(s), F.coalesce(F.exp(step(s)), F.lit(0.0))) for s in specs}
    )
    inside = Window.partitionBy(key, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({t("p", s): F.sum(t("k", s)).over(inside) for s in specs} | {t("enter", s): F.sum(t("e", s)).over(inside) for s in specs})
    part = lambda s: F.exp(t("p", s)) * F.coalesce(F.sum(F.col(t("l", s)) * F.col(s.x) * F.exp(-F.col(t("p", s)))).over(inside), F.lit(0.0))
    df = df.withColumns({t("s", s): part(s) for s in specs} | {t("m", s): F.coalesce(F.exp(t("p", s)) * F.col(t("enter", s)), F.lit(1.0)) for s in specs})
    end = lambda s: F.when(F.col(row) % size == 0, F.struct(F.col(t("s", s)).alias("s"), F.col(t("m", s)).alias("m")))
    chain = lambda c, e: e["s"] + e["m"] * c
    df = df.withColumns({t("c", s): F.aggregate(F.collect_list(end(s)).over(before), F.lit(0.0), chain) for s in specs})
    df = df.withColumns({s.out: F.when(F.col(t("n", s)) >= s.least, F.col(t("s", s)) + F.col(t("m", s)) * F.col(t("c", s))) for s in specs})
    return df.select(*(f"`{n}`" for n in names))
