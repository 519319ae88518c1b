"""Writers of features and results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def features(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A feature table, by symbol; ``kind`` is parquet or csv."""
    writer = df.write.mode("overwrite").partitionBy("symbol")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def results(trades: DataFrame, equity: DataFrame, metrics: DataFrame, path: str) -> None:
    """The three tables of a backtest, side by side."""
    for name, df in (("trades", trades), ("equity", equity), ("metrics", metrics)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def instruments(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """An instrument master; ``kind`` is parquet or csv."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)
