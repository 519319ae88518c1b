"""Window building blocks of the indicators. Missing values are NULL, never NaN; a quotient by zero is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_time() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lag(x: str | Column, k: int = 1) -> Column:
    return F.lag(col(x), k).over(by_time()) if k >= 0 else F.lead(col(x), -k).over(by_time())


def diff(x: str | Column, k: int = 1) -> Column:
    return col(x) - lag(x, k)


def sd(a: str | Column, b: str | Column) -> Column:
    """Quotient, NULL on zero."""
    return F.try_divide(col(a), col(b))


def pct(x: str | Column, k: int = 1) -> Column:
    return sd(x, lag(x, k)) - 1


def frame(x: str | Column, f, first: int, last: int) -> Column:
    """``f`` over the rows from ``first`` to ``last`` against this one."""
    return f(col(x)).over(by_time().rowsBetween(first, last))


def roll(x: str | Column, f, n: int) -> Column:
    """``f`` over the last n rows, NULL unless all n have values."""
    w = by_time().rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(x)).over(w) == n, f(col(x)).over(w))


def before(x: str | Column, f, n: int) -> Column:
    """``f`` over the n rows before this one, NULL unless all n have values."""
    w = by_time().rowsBetween(-n, -1)
    return F.when(F.count(col(x)).over(w) == n, f(col(x)).over(w))


def sma(x: str | Column, n: int) -> Column:
    return roll(x, F.avg, n)


def rsum(x: str | Column, n: int) -> Column:
    return roll(x, F.sum, n)


def std(x: str | Column, n: int) -> Column:
    return roll(x, F.stddev_samp, n)


def high_of(x: str | Column, n: int) -> Column:
    return roll(x, F.max, n)


def low_of(x: str | Column, n: int) -> Column:
    return roll(x, F.min, n)


def cum(x: str | Column) -> Column:
    """Running sum that skips missing values and leaves them missing."""
    return F.when(col(x).isNotNull(), F.sum(col(x)).over(by_time().rowsBetween(Window.unboundedPreceding, 0)))


def ffill(x: str | Column) -> Column:
    return F.last(col(x), ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0))


def flag(cond: Column, value: int = 1, other: int = 0) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(value)).otherwise(F.lit(other))


def place() -> Column:
    """Zero-based row number of the symbol."""
    return F.row_number().over(by_time()) - 1


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def middle() -> Column:
    return (F.col("high") + F.col("low")) / 2


def true_range() -> Column:
    """Greatest of the bar's range and its distances from the last close; on the first row the range."""
    c = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - c), F.abs(F.col("low") - c))


def round2(x: str | Column) -> Column:
    return F.rint(col(x) * 100) / 100


def wma(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """Mean with weights 1..n of the last n rows, each taken by its own lag, so that nothing cancels in long series."""
    total = sum(((n - j) * lag(x, j) for j in range(1, n)), n * F.col(x))
    return df.withColumn(out, total / (n * (n + 1) / 2))
