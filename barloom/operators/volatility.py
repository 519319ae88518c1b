"""Volatility indicators. Each function appends its columns to a frame of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.kernels import ewm, fading, memory_of
from barloom.functions.windows import by_time, diff, ffill, high_of, lag, low_of, pct, sd, sma, std, true_range


def bbands(df: DataFrame, n: int = 14, width: float = 2.0, price: str = "close") -> DataFrame:
    d = df.withColumns({"bb_middle": sma(price, n), "__sd": std(price, n)})
    d = d.withColumns({"bb_upper": F.col("bb_middle") + width * F.col("__sd"), "bb_lower": F.col("bb_middle") - width * F.col("__sd")}).drop("__sd")
    span = F.col("bb_upper") - F.col("bb_lower")
    return d.withColumns({"bb_bandwidth": sd(span, "bb_middle"), "bb_percent": sd(F.col(price) - F.col("bb_lower"), span)})


def atr(df: DataFrame, n: int = 14, out: str = "atr") -> DataFrame:
    d = df.withColumn("__tr", true_range())
    return fading(d, memory_of(n), lambda p: {out: ewm(p["__tr"], n)}, [out]).drop("__tr")


def volatility_stop(df: DataFrame, n: int = 14, multiple: float = 3.0) -> DataFrame:
    d = atr(df, n, "__a")
    return d.withColumns({"stop_long": high_of("high", n) - multiple * F.col("__a"), "stop_short": low_of("low", n) + multiple * F.col("__a")}).drop("__a")


def high_low_range(df: DataFrame, n: int = 14) -> DataFrame:
    span = F.col("high") - F.col("low")
    return df.withColumn("high_low_range", sd(span, sma(span, n)))


def envelope(df: DataFrame, n: int = 20, percent: float = 2.5, price: str = "close") -> DataFrame:
    mid = sma(price, n)
    return df.withColumns({"env_middle": mid, "env_upper": mid * (1 + percent / 100), "env_lower": mid * (1 - percent / 100)})


def ulcer_index(df: DataFrame, n: int = 14, price: str = "close") -> DataFrame:
    d = df.withColumn("__dd", F.coalesce(F.pow(100 * sd(F.col(price) - high_of(price, n), high_of(price, n)), F.lit(2.0)), F.lit(0.0)))
    return d.withColumn("ulcer_index", F.sqrt(sma("__dd", n))).drop("__dd")


def normalized_atr(df: DataFrame, n: int = 14) -> DataFrame:
    return atr(df, n, "__a").withColumn("natr", 100 * sd("__a", "close")).drop("__a")


def relative_volatility_index(df: DataFrame, n: int = 10, smooth: int = 14) -> DataFrame:
    """Spread on rises against spread on falls. Before the spread exists a row counts 0 on the other side and nothing on its own."""
    d = df.withColumns({"__s": std("close", n), "__d": diff("close")})
    d = d.withColumns({"__u": F.when(F.col("__d") > 0, F.col("__s")).otherwise(F.lit(0.0)), "__f": F.when(F.col("__d") < 0, F.col("__s")).otherwise(F.lit(0.0))})

    def fn(p):
        up, down = ewm(p["__u"], smooth), ewm(p["__f"], smooth)
        return {"rvi_volatility": (100 * up / (up + down)).where(up + down != 0)}

    return fading(d, memory_of(smooth), fn, ["rvi_volatility"]).drop("__s", "__d", "__u", "__f")


def cboe_vix(df: DataFrame, short: int = 9, long: int = 30) -> DataFrame:
    d = df.withColumn("__r", F.ln(sd("close", lag("close"))))
    year = 100 * 252**0.5
    d = d.withColumns({"vix_short": year * std("__r", short), "vix_long": year * std("__r", long)}).drop("__r")
    return d.withColumn("vix_ratio", sd("vix_short", "vix_long"))


def z_score(df: DataFrame, n: int = 20, price: str = "close") -> DataFrame:
    return df.withColumn("z_score", sd(F.col(price) - sma(price, n), std(price, n)))


def true_range_percent(df: DataFrame) -> DataFrame:
    return df.withColumn("true_range_percent", 100 * sd(true_range(), lag("close")))


def volatility_ratio(df: DataFrame, short: int = 5, long: int = 20) -> DataFrame:
    d = df.withColumn("__p", pct("close"))
    return d.withColumn("volatility_ratio", sd(std("__p", short), std("__p", long))).drop("__p")


def fractal_chaos_bands(df: DataFrame, n: int = 10) -> DataFrame:
    """Last centred high and low; a band appears at its pivot, so it looks ahead by half the window."""
    k = n // 2
    past, next_ = by_time().rowsBetween(-k, -1), by_time().rowsBetween(1, k)
    full = (F.count("high").over(past) == k) & (F.count("high").over(next_) == k)
    top = F.when(full & (F.col("high") > F.max("high").over(past)) & (F.col("high") >= F.max("high").over(next_)), F.col("high"))
    low = F.when(full & (F.col("low") < F.min("low").over(past)) & (F.col("low") <= F.min("low").over(next_)), F.col("low"))
    d = df.withColumns({"__t": top, "__b": low})
    return d.withColumns({"fcb_upper": ffill("__t"), "fcb_lower": ffill("__b")}).drop("__t", "__b")


def directional_volatility(df: DataFrame, n: int = 14) -> DataFrame:
    """Smoothed change of the mean range in percent, whether it rises (1) or not (-1), and its size."""
    d = atr(df, n, "__a").withColumn("atr_roc", 100 * sd(diff("__a", n), lag("__a", n)))
    d = fading(d, memory_of(n), lambda p: {"atr_roc_ema": ewm(p["atr_roc"], n)}, ["atr_roc_ema"])
    return d.withColumns({"directional_vol": F.when(F.coalesce(F.col("atr_roc_ema") > 0, F.lit(False)), 1).otherwise(-1), "vol_strength": F.abs("atr_roc_ema")}).drop("__a")
