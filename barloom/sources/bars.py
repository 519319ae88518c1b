"""Bars: the one base table (symbol, ts, open, high, low, close, volume), from files or from the events and orders tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampNTZType

BARS = StructType(
    [StructField("symbol", StringType()), StructField("ts", TimestampNTZType()), *[StructField(c, DoubleType()) for c in ("open", "high", "low", "close", "volume")]]
)


def read_csv(spark: SparkSession, path: str, symbol: str = "ALL") -> DataFrame:
    """Bars from CSV with a header: names in any case, time as ts, datetime or date; further columns (a written row number) are dropped."""
    return normalised(spark.read.option("header", True).csv(path), symbol)


def traded(bars: DataFrame) -> DataFrame:
    """Bars with volume; those without, or with none told, are left out."""
    return bars.where("volume != 0")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalised(spark.read.parquet(path))


def normalised(df: DataFrame, symbol: str = "ALL") -> DataFrame:
    """Column names in lower case, a symbol if there is none, and the declared types; missing columns are an error."""
    df = df.toDF(*[c.lower() for c in df.columns])
    for old, new in (("datetime", "ts"), ("date", "ts")):
        if "ts" not in df.columns and old in df.columns:
            df = df.withColumnRenamed(old, new)
    if "symbol" not in df.columns:
        df = df.withColumn("symbol", F.lit(symbol))
    lost = [f.name for f in BARS if f.name not in df.columns]
    if lost:
        raise ValueError(f"bars need the columns {lost}")
    clean = lambda f: F.when(F.isnan(F.col(f.name).cast("double")), None).otherwise(F.col(f.name).cast("double"))
    return df.select(*[clean(f).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name).cast(f.dataType) for f in BARS])


def instrument_master(spark: SparkSession, path: str, exchange: str, kinds: list[str], names: list[str]) -> DataFrame:
    """Instruments from JSON: expiry as a date, strike as a number, filtered by exchange segment, kind and name."""
    raw = spark.read.json(path)
    return raw.withColumns({"expiry": F.to_timestamp("expiry", "ddMMMyyyy"), "strike": F.col("strike").cast("double")}).where(
        (F.col("exch_seg") == exchange) & F.col("instrumenttype").isin(kinds) & F.col("name").isin(names)
    )


def date_range(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of start <= ts <= end; on Parquet this is a pushed filter."""
    return bars.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") <= F.lit(end).cast("timestamp_ntz")))


def synthetic(spark: SparkSession, days: int = 1000, seed: int = 42) -> DataFrame:
    """A random walk of daily bars."""
    from pyspark.sql import Window

    rows = spark.range(days).select(
        F.lit("SYN").alias("symbol"), F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(cast(id as int))").alias("ts"), F.randn(seed).alias("move"), F.rand(seed + 1).alias("spread"), F.rand(seed + 2).alias("v")
    )
    close = 100 + F.sum("move").over(Window.partitionBy("symbol").orderBy("ts"))
    rows = rows.withColumn("close", close).withColumn("open", F.col("close") - F.col("move") / 2)
    return rows.select(
        "symbol", "ts", "open", (F.greatest("open", "close") + F.col("spread")).alias("high"), (F.least("open", "close") - F.col("spread")).alias("low"), "close", (1000 + 9000 * F.col("v")).alias("volume")
    )


def from_ticks(ticks: DataFrame, key: str, ts: str, price: str, tie: str, every: str) -> DataFrame:
    """Bars of ticks by key and time bucket. First and last price by time, then by ``tie``; volume counts the ticks."""
    order = F.struct(F.col(ts), F.col(tie))
    grouped = ticks.groupBy(F.col(key).alias("symbol"), F.window(ts, every).alias("w")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return grouped.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: all events as one symbol, by the hour."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("all", F.lit("ALL"))
    return from_ticks(events, "all", "ts", "value", "event_id", "1 hour")


def by_type(spark: SparkSession, sf_dir: str, every: str = "4 hours") -> DataFrame:
    """B2: events by type."""
    return from_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value", "event_id", every)


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3: order totals by priority and day; orders of a day are in order of their keys."""
    return from_ticks(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey", "1 day")


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: all orders by day."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("all", F.lit("MARKET"))
    return from_ticks(orders, "all", "o_orderdate", "o_totalprice", "o_orderkey", "1 day")
