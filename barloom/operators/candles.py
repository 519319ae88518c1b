"""Candle patterns: flags from the last one to four bars. A pattern that meets a missing value is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.kernels import fading, memory_of
from barloom.functions.windows import flag, lag, round2


class _Bars:
    """Columns of the bars k rows back: o[k], h[k], l[k], c[k]; green(k) closes above its open, red(k) below."""

    def __init__(self):
        self.o, self.h, self.l, self.c = ([F.col(n), *[lag(n, k) for k in (1, 2, 3)]] for n in ("open", "high", "low", "close"))

    def green(self, k: int = 0) -> Column:
        return self.c[k] > self.o[k]

    def red(self, k: int = 0) -> Column:
        return self.c[k] < self.o[k]

    def body(self, k: int = 0) -> Column:
        return F.abs(self.c[k] - self.o[k])

    def upper(self) -> Column:
        return self.h[0] - F.greatest(self.o[0], self.c[0])

    def lower(self) -> Column:
        return F.least(self.o[0], self.c[0]) - self.l[0]

    def span(self) -> Column:
        return self.h[0] - self.l[0]


def _inverted(b: _Bars) -> Column:
    return (b.upper() >= 2 * b.body()) & (b.lower() <= 0.25 * b.span()) & (b.body() > 0)


def _hammer(b: _Bars) -> Column:
    return (b.lower() >= 2 * b.body()) & (b.upper() <= 0.25 * b.span()) & (b.body() > 0)


#: Patterns with one condition: the value of the flag and the condition.
PATTERNS = {
    "doji": (1, lambda b: b.body() <= 0.1 * b.span()),
    "inverted_hammer": (1, _inverted),
    "hammer": (1, _hammer),
    "shooting_star": (-1, lambda b: _inverted(b) & b.green(1)),
    "hanging_man": (-1, lambda b: _hammer(b) & b.green(1)),
    "bullish_engulfing": (1, lambda b: b.red(1) & b.green() & (b.o[0] <= b.c[1]) & (b.c[0] >= b.o[1])),
    "bearish_engulfing": (-1, lambda b: b.green(1) & b.red() & (b.o[0] >= b.c[1]) & (b.c[0] <= b.o[1])),
    "morning_star": (1, lambda b: b.red(2) & (b.body(1) < 0.3 * (b.o[2] - b.c[2])) & b.green() & (b.c[0] > b.o[2])),
    "piercing_pattern": (1, lambda b: b.red(1) & (b.o[0] < b.c[1]) & (b.c[0] > (b.o[1] + b.c[1]) / 2) & (b.c[0] < b.o[1])),
    "dark_cloud_cover": (-1, lambda b: b.green(1) & (b.o[0] > b.c[1]) & (b.c[0] < (b.o[1] + b.c[1]) / 2) & (b.c[0] > b.o[1])),
    "evening_star": (-1, lambda b: b.green(2) & (b.body(1) < 0.3 * (b.c[2] - b.o[2])) & b.red() & (b.c[0] < b.o[2])),
    "three_white_soldiers": (1, lambda b: b.green(2) & b.green(1) & (b.o[1] > b.o[2]) & (b.c[1] > b.c[2]) & b.green() & (b.o[0] > b.o[1]) & (b.c[0] > b.c[1])),
    "three_black_crows": (-1, lambda b: b.red(2) & b.red(1) & (b.o[1] < b.o[2]) & (b.c[1] < b.c[2]) & b.red() & (b.o[0] < b.o[1]) & (b.c[0] < b.c[1])),
    "rickshaw_man": (1, lambda b: (b.body() < 0.1 * b.span()) & (b.upper() > 0.4 * b.span()) & (b.lower() > 0.4 * b.span())),
    "high_wave": (1, lambda b: (b.body() < b.upper()) & (b.body() < b.lower()) & (b.upper() > 0.03) & (b.lower() > 0.03)),
    "matching_low": (1, lambda b: (b.c[0] == b.c[1]) & b.red() & b.red(1)),
    "matching_high": (-1, lambda b: (b.c[0] == b.c[1]) & b.green() & b.green(1)),
    "tasuki_gap": (1, lambda b: b.red(2) & b.red(1) & b.green()),
    "advance_block": (1, lambda b: b.green(2) & b.green(1) & (b.c[1] > b.c[2]) & b.green() & (b.c[0] > b.c[1]) & (b.h[0] - b.c[0] > b.c[0] - b.o[0])),
    "deliberation": (1, lambda b: (b.c[0] > b.c[1]) & (b.c[1] > b.c[2]) & (b.c[0] - b.o[0] < b.c[1] - b.o[1])),
    "tristar": (1, lambda b: (b.body(2) < 0.1) & (b.body(1) < 0.1) & (b.body() < 0.1)),
    "kicker": (1, lambda b: b.red(1) & (b.o[0] > b.c[1]) & b.green()),
    "separating_lines": (1, lambda b: b.green(1) & (b.o[0] == b.o[1]) & b.green()),
    "stick_sandwich": (1, lambda b: b.red(2) & b.green(1) & b.red() & (b.c[0] == b.c[2])),
    "three_inside_up": (1, lambda b: b.red(2) & b.green(1) & (b.c[1] > b.o[2]) & (b.c[0] > b.c[1])),
    "three_inside_down": (-1, lambda b: b.green(2) & b.red(1) & (b.c[1] < b.o[2]) & (b.c[0] < b.c[1])),
    "tower_top": (-1, lambda b: b.green(2) & (b.body(1) < 0.1) & b.red()),
    "ladder_bottom": (1, lambda b: b.red(3) & b.red(2) & b.green(1) & (b.c[0] > b.c[1])),
    "upside_gap_two_crows": (-1, lambda b: b.green(2) & (b.o[1] > b.h[2]) & b.red(1) & (b.o[0] > b.c[1]) & b.red()),
}


def pattern(df: DataFrame, name: str) -> DataFrame:
    value, condition = PATTERNS[name]
    return df.withColumn(f"cdl_{name}", flag(condition(_Bars()), value))


def all_patterns(df: DataFrame) -> DataFrame:
    """All patterns of one condition from one sort."""
    b = _Bars()
    return df.withColumns({f"cdl_{n}": flag(c(b), v) for n, (v, c) in PATTERNS.items()})


def marubozu(df: DataFrame) -> DataFrame:
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 0.001
    return df.withColumn("cdl_marubozu", flag(near("open", "low") & near("close", "high")) - flag(near("open", "high") & near("close", "low") & ~(near("open", "low") & near("close", "high"))))


def spinning_top(df: DataFrame, body: float = 0.3, shadow: float = 2.0) -> DataFrame:
    """Both shadows are measured from the lower end of the body."""
    b = _Bars()
    size = F.when(b.body() == 0, 1e-6).otherwise(b.body())
    end = F.least("open", "close")
    hit = (F.try_divide(size, b.span()) < body) & ((F.col("high") - end) / size > shadow) & ((end - F.col("low")) / size > shadow)
    return df.withColumn("cdl_spinning_top", F.coalesce(hit, F.lit(False)))


def harris_signal(df: DataFrame) -> DataFrame:
    """Four bars that interleave upward give 1; the mirrored rule asks for a high under its own low, so no valid bars give -1."""
    h, lo = _Bars().h, _Bars().l
    up = (h[0] > h[1]) & (h[1] > lo[0]) & (lo[0] > h[2]) & (h[2] > lo[1]) & (lo[1] > h[3]) & (h[3] > lo[2]) & (lo[2] > lo[3])
    down = (h[0] < h[1]) & (h[1] < lo[0]) & (lo[0] < h[2]) & (h[2] < lo[1]) & (lo[1] < h[3]) & (h[3] < lo[2]) & (lo[2] < lo[3])
    return df.withColumn("harris_signal", flag(up) - flag(down))


def heikin_ashi(df: DataFrame) -> DataFrame:
    """Averaged bars in place of the prices, to two decimals. The open is an exponential mean of the closes, half each step."""
    d = df.withColumn("__c", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4)

    def fn(p):
        # y0 = (o0 + c0) / 2, y = (y1 + c1) / 2
        fed = p["__c"].shift(1)
        fed.iloc[0] = (p["open"].iloc[0] + p["close"].iloc[0]) / 2
        return {"__o": fed.ewm(alpha=0.5, adjust=False).mean()}

    d = fading(d, memory_of(3), fn, ["__o"])
    return d.withColumns({"open": round2("__o"), "high": round2(F.greatest("high", "__o", "__c")), "low": round2(F.least("low", "__o", "__c")), "close": round2("__c")}).drop("__o", "__c")
