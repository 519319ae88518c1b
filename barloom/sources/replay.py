"""Recorded candles in place of a live feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.bars import date_range, normalised


def candles(spark: SparkSession, path: str, symbol: str, start: str, end: str) -> DataFrame:
    """The recorded bars of one symbol in a range of time; both filters reach the scan."""
    return date_range(normalised(spark.read.parquet(path)).where(F.col("symbol") == symbol), start, end)


def last_days(spark: SparkSession, path: str, symbol: str, end: str, days: int = 2000) -> DataFrame:
    """The bars of the ``days`` days up to ``end``, from half past nine of the first."""
    bars = normalised(spark.read.parquet(path)).where(F.col("symbol") == symbol)
    stop = F.lit(end).cast("timestamp_ntz")
    begin = F.date_trunc("day", stop - F.make_dt_interval(F.lit(days))) + F.make_dt_interval(F.lit(0), F.lit(9), F.lit(30))
    return bars.where((F.col("ts") >= begin) & (F.col("ts") <= stop))


def with_warm_up(bars: DataFrame, start: str, rows: int) -> DataFrame:
    """Rows from ``start`` on and the ``rows`` before them in each symbol: what an indicator needs to be right from ``start`` on."""
    from pyspark.sql import Window

    late = F.col("ts") >= F.lit(start).cast("timestamp_ntz")
    back = Window.partitionBy("symbol", late).orderBy(F.desc("ts"))
    return bars.withColumn("__k", F.row_number().over(back)).where(late | (F.col("__k") <= rows)).drop("__k")
