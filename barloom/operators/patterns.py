"""Chart patterns. All look ahead by the width of their extrema. Each function appends a flag."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.slices import place
from barloom.functions.windows import by_time, flag


def extrema(df: DataFrame, k: int = 5, price: str = "close") -> DataFrame:
    """``is_peak`` and ``is_trough``: strictly beyond the k rows on each side, as far as there are rows, ends excluded."""
    past, coming = by_time().rowsBetween(-k, -1), by_time().rowsBetween(1, k)
    x = F.col(price)
    return df.withColumns(
        {"is_peak": flag((x > F.max(x).over(past)) & (x > F.max(x).over(coming))), "is_trough": flag((x < F.min(x).over(past)) & (x < F.min(x).over(coming)))}
    )


def _among(df: DataFrame, k: int, kind: str, reach: int, rule: Callable[[Column, Column, Column], Column], out: str) -> DataFrame:
    """Flag extrema that meet ``rule`` with the extrema ``reach`` before and after them.

    The extrema before come from a running window, those after from one in falling order of time: two sorts of one shuffle.
    """
    d = extrema(df, k)
    met = F.col(kind) == 1
    past = by_time().rowsBetween(Window.unboundedPreceding, -1)
    coming = Window.partitionBy("symbol").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"__a": F.col("close"), "__b": F.col("close")})
    for _ in range(reach):
        d = d.withColumns({"__a": F.last(F.when(met, F.col("__a")), ignorenulls=True).over(past), "__b": F.last(F.when(met, F.col("__b")), ignorenulls=True).over(coming)})
    return d.withColumn(out, flag(met & rule(F.col("__a"), F.col("close"), F.col("__b")))).drop("is_peak", "is_trough", "__a", "__b")


def m_top(df: DataFrame, k: int = 5, near: float = 0.01) -> DataFrame:
    return _among(df, k, "is_peak", 1, lambda a, m, b: (F.abs(a - b) / m < near) & (m > a) & (m > b), "m_top")


def w_bottom(df: DataFrame, k: int = 5, near: float = 0.01) -> DataFrame:
    return _among(df, k, "is_trough", 1, lambda a, m, b: (F.abs(a - b) / m < near) & (m < a) & (m < b), "w_bottom")


def head_and_shoulders(df: DataFrame, k: int = 5, near: float = 0.01) -> DataFrame:
    return _among(df, k, "is_peak", 2, lambda a, m, b: (F.abs(a - b) / m < near) & (m > a) & (m > b), "head_and_shoulders")


def inverse_head_and_shoulders(df: DataFrame, k: int = 5, near: float = 0.01) -> DataFrame:
    return _among(df, k, "is_trough", 2, lambda a, m, b: (F.abs(a - b) / m < near) & (m < a) & (m < b), "inverse_head_and_shoulders")


def triple_top(df: DataFrame, k: int = 5, near: float = 0.01) -> DataFrame:
    return _among(df, k, "is_peak", 1, lambda a, m, b: a.isNotNull() & b.isNotNull() & (F.greatest(a, m, b) - F.least(a, m, b) < near * m), "triple_top")


def triple_bottom(df: DataFrame, k: int = 5, near: float = 0.01) -> DataFrame:
    return _among(df, k, "is_trough", 1, lambda a, m, b: a.isNotNull() & b.isNotNull() & (F.greatest(a, m, b) - F.least(a, m, b) < near * m), "triple_bottom")


def cup_handle(df: DataFrame, k: int = 10, ratio: float = 0.1) -> DataFrame:
    return _among(df, k, "is_trough", 1, lambda a, m, b: (a > m) & (m < b) & (F.abs(a - b) / m < ratio), "cup_handle")


def rounding_bottom(df: DataFrame, k: int = 10, least: float = 0.5) -> DataFrame:
    """The quadratic coefficient of a fit over 2k+1 centred rows is over ``least``; by orthogonal polynomials."""
    n = 2 * k + 1
    mean = (n * n - 1) / 12
    weights = [(i * i - mean) for i in range(-k, k + 1)]
    norm = sum(w * w for w in weights)
    w = by_time().rowsBetween(-k, k)
    d = df.withColumns({"__in": F.collect_list("close").over(w)})
    total = F.aggregate(F.zip_with("__in", F.array(*[F.lit(x) for x in weights]), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return d.withColumn("rounding_bottom", flag((F.size("__in") == n) & (F.when(F.size("__in") == n, total) / norm > least))).drop("__in")


def rectangle(df: DataFrame, n: int = 10, near: float = 0.01) -> DataFrame:
    w = by_time().rowsBetween(-n, -1)
    hit = (F.count("close").over(w) == n) & (F.max("close").over(w) - F.min("close").over(w) < near * F.avg("close").over(w))
    return df.withColumn("rectangle", flag(hit))


def _triangle(df: DataFrame, n: int, near: float, up: bool, out: str) -> DataFrame:
    d = df.withColumn("__rn", place(df))
    w = by_time().rowsBetween(-n, -1)
    slope, last = F.regr_slope(F.col("close"), F.col("__rn")).over(w), F.lag("close").over(by_time())
    edge = (F.max if up else F.min)("close").over(w)
    hit = (F.col("__rn") >= n) & ((slope > 0) if up else (slope < 0)) & (F.abs(edge - last) < near * edge)
    return d.withColumn(out, flag(hit)).drop("__rn")


def ascending_triangle(df: DataFrame, n: int = 10, near: float = 0.01) -> DataFrame:
    return _triangle(df, n, near, True, "ascending_triangle")


def descending_triangle(df: DataFrame, n: int = 10, near: float = 0.01) -> DataFrame:
    return _triangle(df, n, near, False, "descending_triangle")


def symmetric_triangle(df: DataFrame, n: int = 10, near: float = 0.05) -> DataFrame:
    """Falling highs and rising lows of three rows each inside the window, at about one pace."""
    d = df.withColumns({"__rn": place(df), "__h": F.max("close").over(by_time().rowsBetween(-2, 0)), "__l": F.min("close").over(by_time().rowsBetween(-2, 0))})
    w = by_time().rowsBetween(-(n - 2), -1)
    top, low = F.regr_slope(F.col("__h"), F.col("__rn")).over(w), F.regr_slope(F.col("__l"), F.col("__rn")).over(w)
    return d.withColumn("symmetric_triangle", flag((F.col("__rn") >= n) & (top < 0) & (low > 0) & (F.abs(top - low) < near))).drop("__rn", "__h", "__l")
