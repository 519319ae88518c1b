"""Long series: a symbol is cut into slices of time, each the work of one task.

``cut`` names the slice and the row number of each bar without sorting a symbol in one place: bars are counted by buckets of
time, buckets become slices of about the wanted rows, and rows are numbered inside their slice on top of what came before. Operators
know a cut frame by its columns ``__slice`` and ``__row`` and then work slice by slice; ``whole`` takes them off. Bars of one
bucket (the 64th part of a slice's time, on average) stay together, so a slice is as long as its buckets make it at least.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import cum

MARKS = ("__slice", "__row")


def is_cut(df: DataFrame) -> bool:
    """Whether ``df`` is cut and not a frame of slices with halos (in those, a slice passes for a symbol)."""
    return "__slice" in df.columns and "__first" not in df.columns


def whole(df: DataFrame) -> DataFrame:
    return df.drop(*MARKS)


def _micros(df: DataFrame) -> Column:
    """Microseconds that grow with ``ts``, whatever the time zone."""
    if dict(df.dtypes)["ts"] == "timestamp":
        return F.unix_micros("ts")
    seconds = F.unix_date(F.to_date("ts")).cast("long") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60
    return (seconds * 1_000_000 + (F.expr("extract(second from ts)") * 1_000_000).cast("long")).cast("long")


def cut(df: DataFrame, rows: int = 100_000, grid: int = 64) -> DataFrame:
    """``df`` with ``__slice`` and ``__row``: slices of about ``rows`` bars in order of time, and zero-based row numbers of the symbol.

    ``df`` is read three times (extent, counts, rows), so it should be a stored table or cheap to compute.
    """
    at = df.withColumn("__at", _micros(df))
    extent = at.groupBy("symbol").agg(F.min("__at").alias("__low"), F.max("__at").alias("__high"), F.count("*").alias("__n"))
    parts = F.ceil(F.col("__n") / rows) * grid
    bucket = F.floor((F.col("__at") - F.col("__low")) / (F.col("__high") - F.col("__low") + 1) * parts)
    placed = at.join(extent, "symbol").withColumn("__bucket", bucket).drop("__low", "__high", "__n", "__at")
    counts = placed.groupBy("symbol", "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("symbol").orderBy("__bucket")) - F.col("__n")
    slices = counts.withColumn("__before", before).withColumn("__slice", F.floor(F.col("__before") / rows))
    slices = slices.withColumn("__start", F.min("__before").over(Window.partitionBy("symbol", "__slice"))).select("symbol", "__bucket", "__slice", "__start")
    number = F.col("__start") + F.row_number().over(Window.partitionBy("symbol", "__slice").orderBy("ts")) - 1
    return placed.join(slices, ["symbol", "__bucket"]).withColumn("__row", number).select(*[F.col(f"`{c}`") for c in df.columns], *MARKS)


def neighbours(df: DataFrame, back: int, ahead: int = 0, rows: int = 100_000) -> DataFrame:
    """Slices of a cut frame with the ``back`` bars before and the ``ahead`` bars after them, each under a symbol of its own.

    Added columns: ``__name`` the symbol, ``__mine`` whether the bar is the slice's own, ``__first`` the row number of the first bar held.
    """
    extent = df.groupBy("symbol", "__slice").agg(F.min("__row").alias("__lo"), F.max("__row").alias("__hi"))
    # Two slices in a row hold more than ``rows`` bars, so that many can be within reach.
    reach = lambda n: 2 * math.ceil(n / rows) + 1
    w = Window.partitionBy("symbol").orderBy("__slice")
    later = F.collect_list(F.struct("__slice", "__lo", "__hi")).over(w.rowsBetween(1, reach(back)))
    earlier = F.collect_list(F.struct("__slice", "__lo", "__hi")).over(w.rowsBetween(-reach(ahead), -1))
    near = extent.select("symbol", "__slice", "__lo", "__hi", F.concat(later, earlier).alias("__near"))
    row = F.col("__row")
    wanted = F.filter("__near", lambda t: ((t["__lo"] > row) & (t["__lo"] - back <= row)) | ((t["__hi"] < row) & (t["__hi"] + ahead >= row)))
    own = F.array(F.struct("__slice", "__lo", "__hi"))
    out = df.join(near, ["symbol", "__slice"]).withColumn("__to", F.explode(F.concat(own, wanted)))
    out = out.withColumns({"__name": F.col("symbol"), "__mine": F.col("__to.__slice") == F.col("__slice"), "__first": F.greatest(F.col("__to.__lo") - back, F.lit(0))})
    return out.withColumn("symbol", F.concat_ws("#", F.col("__to.__slice").cast("string"), "symbol")).drop("__lo", "__hi", "__near", "__to")


def over(df: DataFrame, fn: Callable[[DataFrame], DataFrame], back: int, ahead: int = 0, rows: int = 100_000) -> DataFrame:
    """``fn(df)`` for an ``fn`` that appends columns and looks at most ``back`` bars back and ``ahead`` bars ahead, slice by slice.

    A frame that isn't cut is cut first (``rows``), and comes back without the marks.
    """
    if not is_cut(df):
        return whole(over(cut(df, rows), fn, back, ahead, rows))
    got = fn(neighbours(df, back, ahead, rows)).where("__mine")
    return got.withColumn("symbol", F.col("__name")).drop("__name", "__mine", "__first")


def bounded(df: DataFrame, fn: Callable[[DataFrame], DataFrame], back: int, ahead: int = 0) -> DataFrame:
    """``fn(df)``, slice by slice if ``df`` is cut."""
    return over(df, fn, back, ahead) if is_cut(df) else fn(df)


def place(df: DataFrame) -> Column:
    """Zero-based row number of the symbol; that of a cut frame is at hand."""
    from barloom.functions import windows

    if is_cut(df):
        return F.col("__row")
    return windows.place() + (F.col("__first") if "__first" in df.columns else 0)


def running(df: DataFrame, x: str | Column, out: str) -> DataFrame:
    """Append the running sum of ``x``, which skips missing values and leaves them missing. In a cut frame: inside each slice, on top of the sums of earlier slices."""
    if not is_cut(df):
        return df.withColumn(out, cum(x))
    value = F.col(x) if isinstance(x, str) else x
    d = df.withColumn("__value", value)
    totals = d.groupBy("symbol", "__slice").agg(F.coalesce(F.sum("__value"), F.lit(0)).alias("__total"))
    carried = F.sum("__total").over(Window.partitionBy("symbol").orderBy("__slice")) - F.col("__total")
    own = F.sum("__value").over(Window.partitionBy("symbol", "__slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    d = d.join(totals.select("symbol", "__slice", carried.alias("__carried")), ["symbol", "__slice"])
    return d.withColumn(out, F.when(F.col("__value").isNotNull(), own + F.col("__carried"))).drop("__value", "__carried").select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)


def latest(df: DataFrame, x: str, out: str) -> DataFrame:
    """Append the last value of ``x`` that isn't missing. In a cut frame: inside each slice, else the last of earlier slices."""
    up_to_now = Window.partitionBy("symbol", "__slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    if not is_cut(df):
        return df.withColumn(out, F.last(x, ignorenulls=True).over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))
    ends = df.groupBy("symbol", "__slice").agg(F.max_by(x, F.when(F.col(x).isNotNull(), F.col("ts"))).alias("__end"))
    held = F.last("__end", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    d = df.join(ends.select("symbol", "__slice", held.alias("__held")), ["symbol", "__slice"])
    return d.withColumn(out, F.coalesce(F.last(x, ignorenulls=True).over(up_to_now), "__held")).drop("__held")
