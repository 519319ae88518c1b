"""Support and resistance. Each function appends its columns to a frame of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.kernels import path, walk
from barloom.functions.slices import place
from barloom.functions.windows import by_time, high_of, lag, low_of, sma, std


def pivot_points(df: DataFrame, method: str = "standard", period: int = 1) -> DataFrame:
    """Pivot, supports and resistances from the last ``period`` bars' range and the last close."""
    d = df.withColumns({"__hh": high_of("high", period), "__ll": low_of("low", period)})
    d = d.withColumns({"__h": lag("__hh"), "__l": lag("__ll"), "__c": lag("close")}).drop("__hh", "__ll")
    h, lo, c = F.col("__h"), F.col("__l"), F.col("__c")
    span, p = h - lo, (h + lo + c) / 3
    if method == "standard":
        out = {"pivot_point": p, "r1": 2 * p - lo, "s1": 2 * p - h, "r2": p + span, "s2": p - span, "r3": 2 * p - lo + span, "s3": 2 * p - h - span}
    elif method == "fibonacci":
        out = {"pivot_point": p} | {f"{n}{k}": p + sign * f * span for k, f in ((1, 0.382), (2, 0.618), (3, 1.0)) for n, sign in (("r", 1), ("s", -1))}
    elif method == "camarilla":
        out = {"pivot_point": p} | {f"{n}{k}": c + sign * span * 1.1 / f for k, f in ((1, 12), (2, 6), (3, 4)) for n, sign in (("r", 1), ("s", -1))}
    elif method == "woodie":
        p = (h + lo + 2 * c) / 4
        out = {"pivot_point": p, "r1": 2 * p - lo, "s1": 2 * p - h, "r2": p + span, "s2": p - span}
    else:
        raise ValueError("method must be standard, fibonacci, camarilla or woodie")
    return d.withColumns(out).drop("__h", "__l", "__c")


def swings(df: DataFrame, k: int = 5, threshold: float = 0.0) -> DataFrame:
    """Bars whose high (low) is strictly beyond all ``k`` on each side, by ``threshold`` of the nearest; looks ahead by k."""
    past, coming = by_time().rowsBetween(-k, -1), by_time().rowsBetween(1, k)
    full = (F.count("high").over(past) == k) & (F.count("high").over(coming) == k)
    top, low = F.greatest(F.max("high").over(past), F.max("high").over(coming)), F.least(F.min("low").over(past), F.min("low").over(coming))
    far_top, far_low = F.try_divide(F.col("high"), top) - 1 >= threshold, 1 - F.try_divide(F.col("low"), low) >= threshold
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    return df.withColumns({"swing_high": yes(full & (F.col("high") > top) & far_top), "swing_low": yes(full & (F.col("low") < low) & far_low)})


def order_blocks(df: DataFrame, n: int = 10, move: float = 0.01) -> DataFrame:
    """The last opposite candle before a close-to-close move of more than ``move``, at most n bars back: the candle's high and low; looks ahead by n."""
    d = df.withColumns({"__rn": place(df), "__m": F.try_divide(F.col("close"), lag("close")) - 1})
    ahead = by_time().rowsBetween(1, n)
    out = {}
    for name, strong, opposite in (("bullish_ob", F.col("__m") > move, F.col("close") < F.col("open")), ("bearish_ob", F.col("__m") < -move, F.col("close") > F.col("open"))):
        first = F.min(F.when(strong & (F.col("__rn") >= n), F.col("__rn"))).over(ahead)
        next_ = F.min(F.when(opposite, F.col("__rn"))).over(ahead)
        hit = opposite & (F.col("__rn") >= 1) & first.isNotNull() & (next_.isNull() | (first <= next_))
        out |= {f"{name}_top": F.when(hit, F.col("high")), f"{name}_bottom": F.when(hit, F.col("low"))}
    return d.withColumns(out).drop("__rn", "__m")


def zigzag_walk(percent: float):
    """Turning points bar by bar, for ``walk``: the anchor moves, with the trend or against it, when the price is more than ``percent`` away from it."""

    def go(state: tuple | None, bar: tuple) -> tuple[tuple, tuple]:
        (close,) = bar
        if state is None or state[0] and abs((close / state[0] - 1) * 100) > percent:
            return (close,), (close,)
        return state, (None,)

    return go


def zigzag_path(close: list[float], percent: float) -> list[float | None]:
    """The turning points along the closes of one symbol."""
    return [turn for (turn,) in path(zigzag_walk(percent), zip(close))]


def zigzag(df: DataFrame, percent: float = 5.0) -> DataFrame:
    return walk(df, ["close"], zigzag_walk(percent), ["zigzag"])


def mean_reversion_channel(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """Bands about the mean, and the zones where the close comes back through one."""
    d = df.withColumns({"ma": sma("close", n), "std": std("close", n)})
    d = d.withColumns({"upper_band": F.col("ma") + width * F.col("std"), "lower_band": F.col("ma") - width * F.col("std")})
    c, c1 = F.col("close"), lag("close")
    return d.withColumns(
        {
            "support_zone": F.when((c1 >= lag("lower_band")) & (c < F.col("lower_band")), F.col("lower_band")),
            "resistance_zone": F.when((c1 <= lag("upper_band")) & (c > F.col("upper_band")), F.col("upper_band")),
        }
    )
