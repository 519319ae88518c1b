"""Momentum indicators. Each function appends its columns to a frame of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.kernels import ewm, fading, memory_of
from barloom.functions.windows import by_time, diff, flag, high_of, lag, low_of, middle, place, roll, rsum, sd, sma, true_range, typical, wma


def rsi(df: DataFrame, n: int = 14, price: str = "close", out: str = "rsi") -> DataFrame:
    """Relative strength from simple means; the first change counts as none. No losses give 100, no moves give NULL."""
    d = df.withColumn("__d", F.coalesce(diff(price), F.lit(0.0)))
    d = d.withColumns({"__g": sma(F.greatest("__d", F.lit(0.0)), n), "__l": sma(F.greatest(-F.col("__d"), F.lit(0.0)), n)})
    value = F.when((F.col("__l") == 0) & (F.col("__g") > 0), 100.0).otherwise(100 - 100 / (1 + sd("__g", "__l")))
    return d.withColumn(out, value).drop("__d", "__g", "__l")


def stoch_rsi(df: DataFrame, n: int = 14, k: int = 3, d: int = 3) -> DataFrame:
    x = rsi(df, n, out="__r")
    x = x.withColumn("__s", 100 * sd(F.col("__r") - low_of("__r", n), high_of("__r", n) - low_of("__r", n)))
    x = x.withColumn("stoch_rsi_k", sma("__s", k))
    return x.withColumn("stoch_rsi_d", sma("stoch_rsi_k", d)).drop("__r", "__s")


def stoch(df: DataFrame, n: int = 14, smooth: int = 1, d: int = 3) -> DataFrame:
    x = df.withColumn("stoch_k", 100 * sd(F.col("close") - low_of("low", n), high_of("high", n) - low_of("low", n)))
    if smooth > 1:
        x = x.withColumn("stoch_k", sma("stoch_k", smooth))
    return x.withColumn("stoch_d", sma("stoch_k", d))


def roc(df: DataFrame, n: int = 10, price: str = "close", out: str = "roc") -> DataFrame:
    return df.withColumn(out, 100 * sd(diff(price, n), lag(price, n)))


def ao(df: DataFrame, fast: int = 5, slow: int = 34) -> DataFrame:
    return df.withColumn("ao", sma(middle(), fast) - sma(middle(), slow))


def cci(df: DataFrame, n: int = 20) -> DataFrame:
    """Distance from the mean in units of the mean distance, both over the same window."""
    w = by_time().rowsBetween(-(n - 1), 0)
    d = df.withColumn("__tp", typical())
    d = d.withColumns({"__ma": sma("__tp", n), "__in": F.collect_list("__tp").over(w)})
    mad = F.aggregate("__in", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("__ma"))) / n
    return d.withColumn("cci", sd(F.col("__tp") - F.col("__ma"), 0.015 * mad)).drop("__tp", "__ma", "__in")


def mom(df: DataFrame, n: int = 10, price: str = "close") -> DataFrame:
    return df.withColumn("mom", diff(price, n))


def williamsr(df: DataFrame, n: int = 14) -> DataFrame:
    return df.withColumn("williamsr", -100 * sd(high_of("high", n) - F.col("close"), high_of("high", n) - low_of("low", n)))


def cmo(df: DataFrame, n: int = 14, price: str = "close") -> DataFrame:
    d = df.withColumn("__d", F.coalesce(diff(price), F.lit(0.0)))
    g, lo = rsum(F.greatest("__d", F.lit(0.0)), n), rsum(F.greatest(-F.col("__d"), F.lit(0.0)), n)
    return d.withColumn("cmo", 100 * sd(g - lo, g + lo)).drop("__d")


def uo(df: DataFrame, s: int = 7, m: int = 14, n: int = 28, ws: float = 4, wm: float = 2, wn: float = 1) -> DataFrame:
    d = df.withColumns({"__bp": F.col("close") - F.least("low", lag("close")), "__tr": true_range()})
    part = lambda k: sd(rsum("__bp", k), rsum("__tr", k))
    return d.withColumn("uo", 100 * (ws * part(s) + wm * part(m) + wn * part(n)) / (ws + wm + wn)).drop("__bp", "__tr")


def rsi_divergence(df: DataFrame, n: int = 14) -> DataFrame:
    d = rsi(df, n, out="__r").withColumns({"__p": diff("close", 2)}).withColumn("__q", diff("__r", 2))
    return d.withColumns({"regular_bullish": flag((F.col("__p") < 0) & (F.col("__q") > 0)), "regular_bearish": flag((F.col("__p") > 0) & (F.col("__q") < 0))}).drop("__r", "__p", "__q")


def kst(df: DataFrame, rocs: tuple[int, ...] = (10, 15, 20, 30), means: tuple[int, ...] = (10, 10, 10, 15), signal: int = 9) -> DataFrame:
    d = df
    for k, n in enumerate(rocs):
        d = roc(d, n, out=f"__roc{k}")
    d = d.withColumn("kst", sum((k + 1) * sma(f"__roc{k}", m) for k, m in enumerate(means)))
    return d.withColumn("kst_signal", sma("kst", signal)).drop(*[f"__roc{k}" for k in range(len(rocs))])


def stc(df: DataFrame, fast: int = 23, slow: int = 50, n: int = 10, smooth: int = 3) -> DataFrame:
    """Stochastic of the MACD line against the n rows before, twice, then a mean; no range gives 0."""
    d = fading(df, memory_of(slow), lambda p: {"__m": ewm(p["close"], fast) - ewm(p["close"], slow)}, ["__m"]).withColumn("__rn", place())
    for source, out in (("__m", "__k"), ("__k", "__d")):
        w = by_time().rowsBetween(-n, -1)
        low, high = F.min(source).over(w), F.max(source).over(w)
        d = d.withColumns({"__low": low, "__high": high})
        span = F.col("__high") - F.col("__low")
        d = d.withColumn(out, F.when((F.col("__rn") >= n) & F.col("__low").isNotNull(), F.when(span == 0, 0.0).otherwise(100 * sd(F.col(source) - F.col("__low"), span))))
    return d.withColumn("stc", sma("__d", smooth)).drop("__m", "__rn", "__k", "__d", "__low", "__high")


def els(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, n: int = 13) -> DataFrame:
    """Elder's impulse: 1 where the mean and the histogram both rise, -1 where both fall."""

    def fn(p):
        line = ewm(p["close"], fast) - ewm(p["close"], slow)
        return {"__h": line - ewm(line, signal), "__e": ewm(p["close"], n)}

    d = fading(df, memory_of(slow) + memory_of(signal), fn, ["__h", "__e"]).withColumns({"__a": F.signum(diff("__h")), "__b": F.signum(diff("__e"))})
    return d.withColumn("impulse", F.when(F.coalesce((F.col("__a") > 0) & (F.col("__b") > 0), F.lit(False)), 1).when(F.coalesce((F.col("__a") < 0) & (F.col("__b") < 0), F.lit(False)), -1).otherwise(0)).drop("__h", "__e", "__a", "__b")


def squeeze_momentum(df: DataFrame, n: int = 20, dev: float = 2.0, kc: int = 20, width: float = 1.5) -> DataFrame:
    d = df.withColumns({"__tp": typical(), "__tr": true_range()}).withColumns({"__ma": sma("__tp", n), "__sd": roll("__tp", F.stddev_pop, n), "__kc": sma("__tp", kc), "__atr": sma("__tr", kc), "__hh": high_of("high", kc), "__ll": low_of("low", kc)})
    upper, lower = F.col("__ma") + dev * F.col("__sd"), F.col("__ma") - dev * F.col("__sd")
    on = flag((lower > F.col("__kc") - width * F.col("__atr")) & (upper < F.col("__kc") + width * F.col("__atr")))
    value = F.col("__tp") - ((F.col("__hh") + F.col("__ll")) / 2 + F.col("__kc")) / 2
    return d.withColumns({"squeeze_on": on, "squeeze_momentum": value}).drop("__tp", "__tr", "__ma", "__sd", "__kc", "__atr", "__hh", "__ll")


def rvi(df: DataFrame, n: int = 10) -> DataFrame:
    span = F.col("high") - F.col("low")
    d = df.withColumn("__v", (F.col("close") - F.col("open")) / F.when(span == 0, 1.0).otherwise(span))
    d = wma(d, "__v", n, "rvi")
    return d.withColumn("rvi_signal", sma("rvi", 4)).drop("__v")


def dpo(df: DataFrame, n: int = 20, price: str = "close") -> DataFrame:
    d = df.withColumn("__ma", sma(price, n // 2 + 1))
    return d.withColumn("dpo", F.col(price) - lag("__ma", n // 2)).drop("__ma")


def connors_rsi(df: DataFrame, n: int = 3, streak: int = 2, rank: int = 100, price: str = "close") -> DataFrame:
    """Mean of a short RSI, the RSI of the run of rises or falls, and the share of the window's changes under this one."""
    d = rsi(df, n, price, "__a").withColumns({"__s": F.coalesce(F.signum(diff(price)), F.lit(0.0)), "__c": sd(diff(price), lag(price))})
    d = d.withColumn("__new", F.when((F.col("__s") != lag("__s")) | lag("__s").isNull() | (F.col("__s") == 0), 1).otherwise(0))
    d = d.withColumn("__run", F.sum("__new").over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("__streak", F.col("__s") * F.row_number().over(Window.partitionBy("symbol", "__run").orderBy("ts")))
    d = rsi(d, streak, "__streak", "__b")
    d = d.withColumn("__in", F.collect_list("__c").over(by_time().rowsBetween(-(rank - 1), 0)))
    share = F.when(F.size("__in") == rank, 100.0 * F.size(F.filter("__in", lambda x: x < F.col("__c"))) / rank)
    return d.withColumn("connors_rsi", (F.col("__a") + F.col("__b") + share) / 3).drop("__a", "__b", "__s", "__c", "__new", "__run", "__streak", "__in")


def vortex(df: DataFrame, n: int = 14) -> DataFrame:
    d = df.withColumns({"__p": F.abs(F.col("high") - lag("low")), "__m": F.abs(F.col("low") - lag("high")), "__tr": true_range()})
    return d.withColumns({"vi_plus": sd(rsum("__p", n), rsum("__tr", n)), "vi_minus": sd(rsum("__m", n), rsum("__tr", n))}).drop("__p", "__m", "__tr")


def choppiness(df: DataFrame, n: int = 14) -> DataFrame:
    d = df.withColumn("__tr", true_range())
    return d.withColumn("choppiness", 100 * F.log10(sd(rsum("__tr", n), high_of("high", n) - low_of("low", n))) / F.log10(F.lit(float(n)))).drop("__tr")
