"""Trend indicators. Each function appends its columns to a frame of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.kernels import ewm, fading, memory_of, path, walk
from barloom.functions.slices import place
from barloom.functions.windows import by_time, diff, high_of, lag, low_of, true_range, typical, wma


def ema(df: DataFrame, n: int = 14, price: str = "close") -> DataFrame:
    return fading(df, memory_of(n), lambda p: {"ema": ewm(p[price], n)}, ["ema"])


def dema(df: DataFrame, n: int = 14, price: str = "close") -> DataFrame:
    def fn(p):
        e = ewm(p[price], n)
        return {"dema": 2 * e - ewm(e, n)}

    return fading(df, 2 * memory_of(n), fn, ["dema"])


def tema(df: DataFrame, n: int = 14, price: str = "close") -> DataFrame:
    def fn(p):
        e1 = ewm(p[price], n)
        e2 = ewm(e1, n)
        return {"tema": 3 * e1 - 3 * e2 + ewm(e2, n)}

    return fading(df, 3 * memory_of(n), fn, ["tema"])


def t3(x, n: int, v: float = 0.7):
    """Tillson's T3: six exponential means in a row, mixed by a volume factor."""
    e = [x]
    for _ in range(6):
        e.append(ewm(e[-1], n))
    v2, v3 = v * v, v**3
    return -v3 * e[6] + (3 * v2 + 3 * v3) * e[5] + (-6 * v2 - 3 * v - 3 * v3) * e[4] + (1 + 3 * v + v3 + 3 * v2) * e[3]


def t3ribbon(df: DataFrame, lengths: tuple[int, ...] = (5, 8, 13, 21, 34), price: str = "close") -> DataFrame:
    return fading(df, 6 * memory_of(max(lengths)), lambda p: {f"t3_{n}": t3(p[price], n) for n in lengths}, [f"t3_{n}" for n in lengths])


def trend_lines(df: DataFrame, n: int = 14, price: str = "close") -> DataFrame:
    """Support and resistance of the last n rows; the slope is that of the n rows before this one."""
    d = df.withColumn("__rn", place(df))
    w = by_time().rowsBetween(-n, -1)
    slope = F.when(F.col("__rn") >= n, F.regr_slope(F.col(price), F.col("__rn")).over(w))
    return d.withColumns({"support": low_of(price, n), "resistance": high_of(price, n), "trend": slope}).drop("__rn")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, price: str = "close") -> DataFrame:
    def fn(p):
        line = ewm(p[price], fast) - ewm(p[price], slow)
        s = ewm(line, signal)
        return {"macd": line, "macd_signal": s, "macd_hist": line - s}

    return fading(df, memory_of(slow) + memory_of(signal), fn, ["macd", "macd_signal", "macd_hist"])


def adx(df: DataFrame, n: int = 14, smooth: int = 14) -> DataFrame:
    """Directional movement with exponential means. The fall is compared with the rise already masked, so on a tie it stays."""
    d = df.withColumns({"__tr": true_range(), "__up": diff("high"), "__down": -diff("low")})
    d = d.withColumn("__plus", F.when((F.col("__up") > F.col("__down")) & (F.col("__up") > 0), F.col("__up")).otherwise(F.lit(0.0)))
    d = d.withColumn("__minus", F.when((F.col("__down") > F.col("__plus")) & (F.col("__down") > 0), F.col("__down")).otherwise(F.lit(0.0)))

    def fn(p):
        atr = ewm(p["__tr"], n)
        plus, minus = 100 * ewm(p["__plus"], n) / atr, 100 * ewm(p["__minus"], n) / atr
        total = plus + minus
        dx = (100 * (plus - minus).abs() / total).where(total != 0)
        return {"adx": ewm(dx, smooth), "plus_di": plus, "minus_di": minus}

    return fading(d, memory_of(n) + memory_of(smooth), fn, ["adx", "plus_di", "minus_di"]).drop("__tr", "__up", "__down", "__plus", "__minus")


def sar_step(state: tuple[float, float, float, bool], high: float, low: float, highs, lows, start: float, step: float, most: float) -> tuple[float, float, float, bool]:
    """The next (stop, extreme, speed, rising) by a bar, with the highs and lows of the two bars before it. A reversal is tested before the stop is held back."""
    stop, extreme, speed, up = state
    stop += speed * (extreme - stop)
    if up and low < stop:
        return extreme, low, start, False
    if not up and high > stop:
        return extreme, high, start, True
    if up and high > extreme or not up and low < extreme:
        extreme, speed = high if up else low, min(speed + step, most)
    return (min(stop, *lows) if up else max(stop, *highs)), extreme, speed, up


def sar_walk(start: float, step: float, most: float):
    """The stop bar by bar, for ``walk``: its state is the stop, the extreme, the speed, the side and the last two bars. It begins below the first bar, rising."""

    def go(state: tuple | None, bar: tuple) -> tuple[tuple, tuple]:
        high, low = bar
        if state is None:
            return (low, high, start, 1.0, high, low, high, low), (low,)
        stop, extreme, speed, up, h1, l1, h2, l2 = state
        stop, extreme, speed, up = sar_step((stop, extreme, speed, up > 0), high, low, (h1, h2), (l1, l2), start, step, most)
        return (stop, extreme, speed, float(up), high, low, h1, l1), (stop,)

    return go


def sar_path(high, low, start: float, step: float, most: float) -> list[float]:
    """The stop along the bars of one symbol."""
    return [stop for (stop,) in path(sar_walk(start, step, most), zip(high, low))]


def parabolic_sar(df: DataFrame, start: float = 0.02, step: float = 0.02, most: float = 0.2) -> DataFrame:
    return walk(df, ["high", "low"], sar_walk(start, step, most), ["psar"])


def ichimoku(df: DataFrame, tenkan: int = 9, kijun: int = 26, span_b: int = 52, shift: int = 26) -> DataFrame:
    """The cloud. The chikou line looks ahead by ``shift`` rows."""
    mid = lambda n: (high_of("high", n) + low_of("low", n)) / 2
    d = df.withColumns({"tenkan": mid(tenkan), "kijun": mid(kijun), "__b": mid(span_b)})
    return d.withColumns({"span_a": (lag("tenkan", shift) + lag("kijun", shift)) / 2, "span_b": lag("__b", shift), "chikou": lag("close", -shift)}).drop("__b")


def hma(df: DataFrame, n: int = 16, price: str = "close") -> DataFrame:
    d = wma(wma(df, price, n // 2, "__half"), price, n, "__whole")
    d = d.withColumn("__raw", 2 * F.col("__half") - F.col("__whole"))
    return wma(d, "__raw", int(n**0.5), "hma").drop("__half", "__whole", "__raw")


def donchian_channel(df: DataFrame, n: int = 20) -> DataFrame:
    d = df.withColumns({"donchian_upper": high_of("high", n), "donchian_lower": low_of("low", n)})
    return d.withColumn("donchian_middle", (F.col("donchian_upper") + F.col("donchian_lower")) / 2)


def keltner_channel(df: DataFrame, n: int = 20, atr: int = 10, width: float = 2.0) -> DataFrame:
    d = df.withColumns({"__tp": typical(), "__tr": true_range()})

    def fn(p):
        mid, a = ewm(p["__tp"], n), ewm(p["__tr"], atr)
        return {"keltner_middle": mid, "keltner_upper": mid + width * a, "keltner_lower": mid - width * a}

    return fading(d, memory_of(max(n, atr)), fn, ["keltner_middle", "keltner_upper", "keltner_lower"]).drop("__tp", "__tr")


def gmma(df: DataFrame, short: tuple[int, ...] = (3, 5, 8, 10, 12, 15), long: tuple[int, ...] = (30, 35, 40, 45, 50, 60), price: str = "close") -> DataFrame:
    names = {f"short_ema_{n}": n for n in short} | {f"long_ema_{n}": n for n in long}
    return fading(df, memory_of(max(names.values())), lambda p: {c: ewm(p[price], n) for c, n in names.items()}, list(names))
