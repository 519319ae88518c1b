"""Rule signals: 1 buy, -1 sell, 0 none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import lag
from barloom.operators import candles, momentum, trend, volume


def _side(buy: Column, sell: Column) -> Column:
    no = F.lit(False)
    return F.when(F.coalesce(buy, no), 1).when(F.coalesce(sell, no), -1).otherwise(0)


def macd_uo_tsv(df: DataFrame) -> DataFrame:
    """On averaged bars: the MACD over its signal, a strong ultimate oscillator and rising volume flow; mirrored for -1."""
    d = volume.tsv(momentum.uo(trend.macd(candles.heikin_ashi(df))))
    up = (F.col("macd") > F.col("macd_signal")) & (F.col("uo") > 70) & (F.col("tsv") > 0)
    down = (F.col("macd") < F.col("macd_signal")) & (F.col("uo") < 30) & (F.col("tsv") < 0)
    return d.withColumn("signal", _side(up, down))


def harris_t3(df: DataFrame) -> DataFrame:
    """On averaged bars: the four-bar signal with one of two T3 lines not against it."""
    d = candles.harris_signal(trend.t3ribbon(candles.heikin_ashi(df), (8, 13)))
    up = (F.col("harris_signal") == 1) & ((F.col("t3_8") >= lag("t3_8")) | (F.col("t3_13") >= lag("t3_13")))
    down = (F.col("harris_signal") == -1) & ((F.col("t3_8") <= lag("t3_8")) | (F.col("t3_13") <= lag("t3_13")))
    return d.withColumn("signal", _side(up, down))


def mfi_turn(df: DataFrame, n: int = 10, low: float = 40, high: float = 60) -> DataFrame:
    """On averaged bars: money flow at most ``low`` and rising two bars while the close falls two bars; mirrored for -1."""
    d = volume.mfi(candles.heikin_ashi(df), n)
    m, c = [F.col("mfi"), lag("mfi"), lag("mfi", 2)], [F.col("close"), lag("close"), lag("close", 2)]
    up = (m[0] <= low) & (m[0] > m[1]) & (m[1] > m[2]) & (c[0] < c[1]) & (c[1] < c[2])
    down = (m[0] >= high) & (m[0] < m[1]) & (m[1] < m[2]) & (c[0] > c[1]) & (c[1] > c[2])
    return d.withColumn("signal", _side(up, down))


def latest(df: DataFrame) -> DataFrame:
    """The last row of each symbol, with the side that its signal asks for."""
    last = df.withColumn("__k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where("__k = 1").drop("__k")
    return last.withColumn("action", F.when(F.col("signal") == 1, "BUY").when(F.col("signal") == -1, "SELL"))


def confirmed(bars: DataFrame, predicted: DataFrame, n: int = 50, least: float = 0.6) -> DataFrame:
    """``signal`` where a prediction (symbol, ts, prediction, confidence) is surer than ``least`` and the close is on its side of the exponential mean of ``n``."""
    d = trend.ema(bars, n).join(predicted.select("symbol", "ts", "prediction", "confidence"), ["symbol", "ts"])
    sure = F.col("confidence") > least
    return d.withColumn("signal", _side(sure & (F.col("prediction") == 1) & (F.col("close") > F.col("ema")), sure & (F.col("prediction") == 0) & (F.col("close") < F.col("ema"))))
