"""Further indicators. Each function appends its columns to a frame of bars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.kernels import affine, ewm, fading, memory_of, walk
from barloom.functions.slices import bounded, place
from barloom.functions.windows import by_time, before, diff, flag, lag, middle, roll, sma, true_range


def supertrend(df: DataFrame, n: int = 10, multiple: float = 3.0) -> DataFrame:
    """Bands of the mean range that only tighten while the price stays inside; rows before n are 0."""
    d = bounded(df, lambda d: d.withColumn("__tr", true_range()).withColumn("__a", sma("__tr", n)), n + 1)
    d = d.withColumns({"__up": middle() + multiple * F.col("__a"), "__low": middle() - multiple * F.col("__a")})

    def go(state: tuple | None, bar: tuple) -> tuple[tuple, tuple]:
        # The state: both lines, and the last bar's close and bands.
        row, close, up, low = bar
        top, bottom, last, last_up, last_low = state or (0.0, 0.0, close, up, low)
        line, way = 0.0, 0.0
        if row >= n:
            top = min(up, top) if last <= top or up < last_up else up
            bottom = max(low, bottom) if last >= bottom or low > last_low else low
            line, way = (top, -1.0) if close <= top else (bottom, 1.0)
        return (top, bottom, close, up, low), (line, way)

    d = d.withColumn("__rn", place(d))
    return walk(d, ["__rn", "close", "__up", "__low"], go, ["supertrend", "supertrend_direction"]).drop("__rn", "__a", "__tr", "__up", "__low")


def vervoort_tsi(df: DataFrame, slow: int = 25, fast: int = 13, signal: int = 7) -> DataFrame:
    d = df.withColumn("__d", diff("close"))

    def fn(p):
        top, size = ewm(ewm(p["__d"], slow), fast), ewm(ewm(p["__d"].abs(), slow), fast)
        tsi = (100 * top / size).where(size != 0)
        s = ewm(tsi, signal)
        return {"tsi": tsi, "tsi_signal": s, "tsi_hist": tsi - s}

    return fading(d, memory_of(slow) + memory_of(fast) + memory_of(signal), fn, ["tsi", "tsi_signal", "tsi_hist"]).drop("__d")


def regression_channel(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """Least squares over the last n rows: slope, intercept at the first of them, r2 (NULL for constant prices), end and bands."""
    d = df.withColumn("__rn", place(df))
    w = by_time().rowsBetween(-(n - 1), 0)
    full = F.count("close").over(w) == n
    x, y = F.col("__rn"), F.col("close")
    d = d.withColumns(
        {
            "reg_slope": F.when(full, F.regr_slope(y, x).over(w)),
            "__i": F.when(full, F.regr_intercept(y, x).over(w)),
            "reg_r2": F.when(full & (F.max("close").over(w) > F.min("close").over(w)), F.regr_r2(y, x).over(w)),
            "__sse": F.when(full, F.greatest(F.regr_syy(y, x).over(w) - F.regr_slope(y, x).over(w) * F.regr_sxy(y, x).over(w), F.lit(0.0))),
        }
    )
    d = d.withColumns({"reg_intercept": F.col("__i") + F.col("reg_slope") * (x - n + 1), "reg_line": F.col("__i") + F.col("reg_slope") * x, "__e": width * F.sqrt(F.col("__sse") / (n - 2))})
    return d.withColumns({"reg_upper": F.col("reg_line") + F.col("__e"), "reg_lower": F.col("reg_line") - F.col("__e")}).drop("__rn", "__i", "__sse", "__e")


def vidya(df: DataFrame, n: int = 9, period: int = 26) -> DataFrame:
    """A mean whose weight follows the momentum of the last n changes; begins at row n with the price."""
    rises = {"__g": roll(F.when(F.col("__d") >= 0, F.col("__d")).otherwise(0.0), F.sum, n), "__l": roll(F.when(F.col("__d") < 0, -F.col("__d")).otherwise(0.0), F.sum, n)}
    d = bounded(df, lambda d: d.withColumn("__d", diff("close")).withColumns(rises), n + 1)
    weight = 2 / (period + 1) * F.coalesce(F.abs(F.try_divide(F.col("__g") - F.col("__l"), F.col("__g") + F.col("__l"))), F.lit(0.0))
    d = d.withColumn("__rn", place(d))
    d = d.withColumns({"__a": F.when(F.col("__rn") == n, 0.0).when(F.col("__rn") > n, 1 - weight), "__b": F.when(F.col("__rn") == n, F.col("close")).when(F.col("__rn") > n, weight * F.col("close"))})
    return affine(d.drop("__rn"), "__a", "__b", "vidya").drop("__d", "__g", "__l", "__a", "__b")


def instantaneous_trendline(df: DataFrame, alpha: float = 0.07) -> DataFrame:
    """A mean that takes double weight while the price is not above it."""

    def go(state: tuple | None, bar: tuple) -> tuple[tuple, tuple]:
        (v,) = bar
        if state is None:
            return (v,), (v,)
        a = alpha if v > state[0] else 2 * alpha
        out = a * v + (1 - a) * state[0]
        return (out,), (out,)

    return walk(df, ["close"], go, ["it"])


def zlsma(df: DataFrame, n: int = 50) -> DataFrame:
    d = df.withColumn("__x", 2 * F.col("close") - lag("close", (n - 1) // 2))
    return fading(d, memory_of(n), lambda p: {"zlsma": ewm(p["__x"], n)}, ["zlsma"]).drop("__x")


def mcginley_dynamic(df: DataFrame, n: int = 14, k: float = 0.6) -> DataFrame:
    """A mean that follows falls faster than rises; begins with the mean of the first n. Where it leaves all bounds it ends (NULL)."""

    def go(state: tuple | None, bar: tuple) -> tuple[tuple, tuple]:
        row, x, first = bar
        if row < n:
            out = first if row == n - 1 else math.nan
        else:
            last = first if state is None else state[0]  # a guess begins anywhere
            try:
                pace = (x / last) ** 4
            except (ZeroDivisionError, OverflowError):
                pace = math.inf if x else math.nan
            out = last + (x - last) / (k * n * pace) if pace else math.nan
        return (out,), (out if math.isfinite(out) else None,)

    d = bounded(df, lambda d: d.withColumns({"__rn": place(d), "__m": sma("close", n)}), n)
    return walk(d, ["__rn", "close", "__m"], go, ["mcginley"]).drop("__rn", "__m")


def ib_boxes(df: DataFrame, period: int = 1) -> DataFrame:
    """Bars inside the range of the ``period`` bars before, breakouts from them, and the box of the first of a run, held until a breakout."""
    d = df.withColumns({"__h": before("high", F.max, period), "__l": before("low", F.min, period)})
    inside = (F.col("high") <= F.col("__h")) & (F.col("low") >= F.col("__l"))
    d = d.withColumns({"inside_bar": flag(inside), "ib_high": F.when(inside, F.col("__h")), "ib_low": F.when(inside, F.col("__l"))}).drop("__h", "__l")
    d = d.withColumn("ib_breakout", F.when(F.col("close") > lag("ib_high"), 1).when(F.col("close") < lag("ib_low"), -1).otherwise(0))
    ends = flag((F.col("ib_breakout") != 0) & (F.col("inside_bar") == 0))
    d = d.withColumn("__g", F.sum(ends).over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy("symbol", "__g").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumns({"ib_high_line": F.first("ib_high", ignorenulls=True).over(w), "ib_low_line": F.first("ib_low", ignorenulls=True).over(w)}).drop("__g")


def frama(df: DataFrame, n: int = 16, fast: int = 1, slow: int = 200) -> DataFrame:
    """Fractal adaptive mean: the weight follows the dimension of the n bars before; begins with the mean of the first n."""
    half = n // 2
    edge = lambda f, a, b: f("close").over(by_time().rowsBetween(a, b))
    span = lambda a, b, k: (edge(F.max, a, b) - edge(F.min, a, b)) / k
    first = F.avg("close").over(by_time().rowsBetween(-(n - 1), 0))
    d = bounded(df, lambda d: d.withColumns({"__n1": span(-n, -half - 1, half), "__n2": span(-half, -1, half), "__n3": span(-n, -1, n), "__m": first}), n)
    parts = F.col("__n1") + F.col("__n2")
    dimension = F.when(parts > 0, F.when(F.col("__n3") > 0, F.log2(parts / F.col("__n3"))).otherwise(2.0)).otherwise(1.0)
    speed = F.exp(-4.6 * (F.least(F.greatest(dimension, F.lit(1.0)), F.lit(2.0)) - 1))
    weight = 2 / (speed * (fast - slow) + slow + 1)
    d = d.withColumns({"__rn": place(d), "__w": weight})
    d = d.withColumns({"__a": F.when(F.col("__rn") == n - 1, 0.0).when(F.col("__rn") >= n, 1 - F.col("__w")), "__b": F.when(F.col("__rn") == n - 1, F.col("__m")).when(F.col("__rn") >= n, F.col("__w") * F.col("close"))})
    return affine(d.drop("__rn"), "__a", "__b", "frama").drop("__n1", "__n2", "__n3", "__w", "__m", "__a", "__b")
