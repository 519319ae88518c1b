"""Regime, sentiment and portfolio statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.slices import MARKS, bounded
from barloom.functions.windows import by_time, lag, pct, sd


def hurst(df: DataFrame, longest: int = 100, price: str = "close") -> DataFrame:
    """One row a symbol: the slope of ln(spread of the change over a lag) on ln(lag), for lags 2 .. longest-1, and the regime.

    Each bar carries the prices before it as one array (one window), and gives its changes as rows, which are aggregated before they are shuffled.
    """

    def changes(d: DataFrame) -> DataFrame:
        past = F.collect_list(F.struct(F.col(price).alias("v"))).over(by_time().rowsBetween(1 - longest, 0))
        return d.withColumn("__past", past)

    d = bounded(df.select("symbol", "ts", price, *[c for c in MARKS if c in df.columns]), changes, longest)
    held = F.size("__past")
    change = F.transform(F.sequence(F.lit(2), held - 1), lambda k: F.struct(k.cast("double").alias("lag"), (F.col(price) - F.element_at("__past", -1 - k)["v"]).alias("d")))
    spread = d.where(held > 2).select("symbol", F.explode(change).alias("x")).groupBy("symbol", "x.lag").agg(F.stddev_pop("x.d").alias("s")).where("s > 0")
    out = spread.groupBy("symbol").agg(F.regr_slope(F.ln("s"), F.ln("lag")).alias("hurst"))
    return out.withColumn("regime", F.when(F.col("hurst") < 0.5, "mean reverting").when(F.col("hurst") > 0.5, "trending").otherwise("random"))


def distribution_days(df: DataFrame, drop: float = 0.2) -> DataFrame:
    """Falls of more than ``drop`` percent on more volume than the day before."""
    fall = (F.col("close") < lag("close")) & (F.col("volume") > lag("volume")) & (sd(lag("close") - F.col("close"), lag("close")) * 100 > drop)
    return df.select("symbol", "ts", "close", "volume", F.coalesce(fall, F.lit(False)).alias("distribution_day"))


def canslim(df: DataFrame, factors: tuple[str, ...] = ("c", "a", "n", "s", "l", "i", "m")) -> DataFrame:
    """The mean of seven factors in words."""
    score = sum((F.col(c) for c in factors), F.lit(0.0)) / len(factors)
    words = F.when(score >= 0.7, "Strong Bullish").when(score >= 0.3, "Bullish").when(score <= -0.7, "Strong Bearish").when(score <= -0.3, "Bearish").otherwise("Neutral")
    return df.withColumns({"canslim_score": score, "canslim": words})


def returns(df: DataFrame) -> DataFrame:
    return df.withColumn("ret", pct("close")).where(F.col("ret").isNotNull())


def inverse_volatility(stocks: DataFrame, market: DataFrame) -> DataFrame:
    """One row a symbol: volatility, beta against the market and weight by inverse volatility.

    Bars are joined with the market's by time first; changes are between joined rows. A series of one market is small next
    to the bars and is broadcast by the optimiser where its size allows.
    """
    both = stocks.select("symbol", "ts", "close").join(market.select("ts", F.col("close").alias("__m")), "ts")
    both = both.withColumns({"r": pct("close"), "m": pct("__m")}).where(F.col("r").isNotNull() & F.col("m").isNotNull())
    stats = both.groupBy("symbol").agg(F.stddev_samp("r").alias("volatility"), (F.covar_samp("r", "m") / F.var_samp("m")).alias("beta"))
    inverse = sd(F.lit(1.0), "volatility")
    return stats.select("symbol", "volatility", "beta", (inverse / F.sum(inverse).over(Window.partitionBy())).alias("weight"))  # one row a symbol


def heaviest(weights: DataFrame, n: int = 10, column: str = "weight") -> DataFrame:
    """The ``n`` rows with the largest weights, whatever their sign; ties by symbol."""
    return weights.orderBy(F.desc(F.abs(column)), "symbol").limit(n)


def signal_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("signal").agg(F.count("*").alias("n"))
