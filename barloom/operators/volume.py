"""Volume indicators. Each function appends its columns to a frame of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.kernels import ewm, fading, memory_of
from barloom.functions.slices import bounded, running
from barloom.functions.windows import cum, diff, lag, middle, pct, rsum, sd, sma, std, typical


def obv(df: DataFrame) -> DataFrame:
    d = bounded(df, lambda d: d.withColumn("__v", F.coalesce(F.signum(diff("close")), F.lit(0.0)) * F.col("volume")), 1)
    return running(d, "__v", "obv").drop("__v")


def vma(df: DataFrame, n: int = 20) -> DataFrame:
    return df.withColumn("vma", sma("volume", n))


def vo(df: DataFrame, short: int = 5, long: int = 10) -> DataFrame:
    gap = sma("volume", short) - sma("volume", long)
    return df.withColumns({"vo": gap, "vo_percent": 100 * sd(gap, sma("volume", long))})


def _flow(df: DataFrame) -> DataFrame:
    """Money flow volume ``__mfv``: where the close lies in the bar, times volume; no range counts as none."""
    place = sd((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low"))
    return df.withColumn("__mfv", F.coalesce(place, F.lit(0.0)) * F.col("volume"))


def cmf(df: DataFrame, n: int = 20) -> DataFrame:
    return _flow(df).withColumn("cmf", sd(rsum("__mfv", n), rsum("volume", n))).drop("__mfv")


def adline(df: DataFrame) -> DataFrame:
    return running(_flow(df), "__mfv", "adline").drop("__mfv")


def mfi(df: DataFrame, n: int = 14, out: str = "mfi") -> DataFrame:
    """Money flow index; no negative flow counts as a ratio of 100."""
    d = df.withColumn("__tp", typical()).withColumns({"__d": diff("__tp"), "__f": F.col("__tp") * F.col("volume")})
    d = d.withColumns({"__p": F.when(F.col("__d") > 0, F.col("__f")).otherwise(F.lit(0.0)), "__n": F.when(F.col("__d") < 0, F.col("__f")).otherwise(F.lit(0.0))})
    ratio = F.when(rsum("__n", n) == 0, 100.0).otherwise(sd(rsum("__p", n), rsum("__n", n)))
    return d.withColumn("__q", ratio).withColumn(out, 100 - 100 / (1 + F.col("__q"))).drop("__tp", "__d", "__f", "__p", "__n", "__q")


def vwap(df: DataFrame, period: str | None = "day") -> DataFrame:
    """Mean price by volume since the start of the calendar period, or since the first row."""
    d = df.withColumns({"__p": F.date_trunc(period, "ts") if period else F.lit(0), "__pv": typical() * F.col("volume")})
    w = Window.partitionBy("symbol", "__p").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("vwap", sd(F.sum("__pv").over(w), F.sum("volume").over(w))).drop("__p", "__pv")


def eom(df: DataFrame, n: int = 14, divisor: float = 10000) -> DataFrame:
    move = middle() - (lag("high") + lag("low")) / 2
    d = df.withColumns({"__m": move, "__box": sd(F.col("volume") / divisor, F.col("high") - F.col("low"))})
    d = d.withColumn("__e", sd("__m", "__box"))
    return d.withColumn("eom", sma("__e", n)).drop("__m", "__box", "__e")


def pvt(df: DataFrame) -> DataFrame:
    return running(bounded(df, lambda d: d.withColumn("__x", pct("close") * F.col("volume")), 1), "__x", "pvt").drop("__x")


def fi(df: DataFrame, n: int = 13) -> DataFrame:
    d = df.withColumn("__x", diff("close") * F.col("volume"))
    return fading(d, memory_of(n), lambda p: {"fi": ewm(p["__x"], n)}, ["fi"]).drop("__x")


def kvo(df: DataFrame, short: int = 34, long: int = 55, signal: int = 13) -> DataFrame:
    d = df.withColumn("__tp", typical()).withColumn("__x", F.col("volume") * F.signum(diff("__tp")))

    def fn(p):
        line = ewm(p["__x"], short) - ewm(p["__x"], long)
        return {"kvo": line, "kvo_signal": ewm(line, signal)}

    return fading(d, memory_of(long) + memory_of(signal), fn, ["kvo", "kvo_signal"]).drop("__tp", "__x")


def iii(df: DataFrame) -> DataFrame:
    c, h, lo = F.col("close"), F.col("high"), F.col("low")
    return df.withColumn("iii", F.coalesce(sd(2 * c - h - lo, (h - lo) * F.col("volume")), F.lit(0.0)))


def nv(df: DataFrame, n: int = 14, out: str = "nv") -> DataFrame:
    return df.withColumn(out, sd("volume", sma("volume", n)))


def rvol(df: DataFrame, n: int = 20) -> DataFrame:
    return nv(df, n, "rvol")


def dv(df: DataFrame, n: int = 1) -> DataFrame:
    return df.withColumn("dv", diff("volume", n))


def tsv(df: DataFrame, n: int = 13) -> DataFrame:
    return df.withColumn("__x", diff("close") * F.col("volume")).withColumn("tsv", rsum("__x", n)).drop("__x")


def vzo(df: DataFrame, n: int = 14, smooth: int = 6) -> DataFrame:
    d = df.withColumn("__x", F.coalesce(F.signum(diff("close")), F.lit(0.0)) * F.col("volume"))

    def fn(p):
        base = ewm(p["volume"], n)
        ratio = (100 * ewm(p["__x"], n) / base).where(base != 0)
        return {"vzo": ewm(ratio, smooth)}

    return fading(d, memory_of(n) + memory_of(smooth), fn, ["vzo"]).drop("__x")


def tvi(df: DataFrame, tick: float = 0.01, n: int = 14) -> DataFrame:
    d = df.withColumn("__x", sd("volume", F.abs(diff("close")) / tick))
    return d.withColumn("tvi", sma("__x", n)).drop("__x")


def cdv(df: DataFrame) -> DataFrame:
    d = df.withColumn("delta_volume", F.signum(diff("close")) * F.col("volume"))
    return running(d, "delta_volume", "cdv")


def vfi(df: DataFrame, n: int = 130, coef: float = 0.2, vcoef: float = 2.5, smooth: int = 5) -> DataFrame:
    """Volume flow: the way of the middle price where it moves by more than a share of the mean range, times the log volume
    where that jumps by more than ``vcoef`` of its usual spread, up or down. Rows without a log volume are passed over."""
    d = df.withColumns({"__cut": coef * sma(F.col("high") - F.col("low"), n), "__mid": middle(), "__lv": F.ln(F.nullif("volume", F.lit(0.0)))})
    d = d.withColumns({"__d": diff("__mid"), "__lr": F.coalesce(diff("__lv"), F.lit(0.0))}).withColumn("__most", vcoef * std("__lr", n))
    way = F.when(F.col("__d") > F.col("__cut"), 1).when(F.col("__d") < -F.col("__cut"), -1).otherwise(0)
    size = F.when(F.col("__lr") > F.col("__most"), F.col("__lv")).when(F.col("__lr") < -F.col("__most"), -F.col("__lv")).otherwise(F.lit(0.0))
    d = d.withColumn("__x", F.coalesce(way * size, F.lit(0.0))).withColumn("__c", cum("__x"))
    return fading(d, memory_of(smooth), lambda p: {"vfi": ewm(p["__c"], smooth)}, ["vfi"]).drop("__cut", "__mid", "__lv", "__d", "__lr", "__most", "__x", "__c")
