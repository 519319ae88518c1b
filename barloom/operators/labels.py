"""Labels, sequences, features and splits for learning from bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.slices import place
from barloom.functions.windows import by_time, flag, lag, pct, sd


def three_way(df: DataFrame, ahead: int = 5, least: float = 0.002) -> DataFrame:
    """2 for a rise of more than ``least`` within ``ahead`` rows, 1 for such a fall, else 0; looks ahead."""
    move = sd(lag("close", -ahead), "close") - 1
    return df.withColumn("label", F.when(F.coalesce(move > least, F.lit(False)), 2).when(F.coalesce(move < -least, F.lit(False)), 1).otherwise(0))


def next_up(df: DataFrame) -> DataFrame:
    """1 if the next close is higher; looks ahead by one row."""
    return df.withColumns({"future_return": sd(lag("close", -1), "close") - 1}).withColumn("target", flag(F.col("future_return") > 0))


def next_sign(df: DataFrame) -> DataFrame:
    """Sign of the next change; looks ahead by one row."""
    d = df.withColumn("__p", F.signum(pct("close")))
    return d.withColumn("target", lag("__p", -1)).drop("__p")


def windows_ending_here(df: DataFrame, k: int, column: str = "close", label: str = "label") -> DataFrame:
    """The last k values of a column with the label of the last of them; rows without k values are left out."""
    w = by_time().rowsBetween(-(k - 1), 0)
    return df.withColumn("sequence", F.collect_list(column).over(w)).where(F.size("sequence") == k).select("symbol", "ts", "sequence", label)


def windows_before(df: DataFrame, k: int = 10, column: str = "close", label: str = "label") -> DataFrame:
    """The k values before a row with the row's own label."""
    w = by_time().rowsBetween(-k, -1)
    return df.withColumn("sequence", F.collect_list(column).over(w)).where(F.size("sequence") == k).select("symbol", "ts", "sequence", label)


def split_by_time(df: DataFrame, share: float = 0.8) -> DataFrame:
    """``is_train`` for the first ``share`` of each symbol's rows."""
    whole = F.count("*").over(Window.partitionBy("symbol"))
    return df.withColumn("is_train", place(df) < F.floor(whole * share))


def standardised(df: DataFrame, columns: list[str], train: str = "is_train") -> DataFrame:
    """Columns less their mean, over their spread, both of the symbol's training rows; constant columns become 0."""
    w = Window.partitionBy("symbol")
    own = lambda c: F.when(F.col(train), F.col(c))
    return df.withColumns({c: F.coalesce(sd(F.col(c) - F.avg(own(c)).over(w), F.stddev_pop(own(c)).over(w)), F.when(F.col(c).isNotNull(), 0.0)) for c in columns})
