"""A ledger of paper orders: events that are only ever appended, and what they make of each order.

An order is NEW, PARTIAL, FILLED, CANCELLED or REFUSED. Its events are (order_id, at, event, quantity, price): ``new`` asks for a
quantity (and a limit price, NULL for any), ``fill`` executes some of it, ``change`` sets what isn't NULL, ``cancel`` ends it, ``refuse`` turns it away.
Orders of a stream are written by the number of their batch, so a batch that runs again finds its own events and writes none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "order_id string, symbol string, side string, at timestamp, event string, quantity long, price double"
ENDS = ("cancel", "refuse")


def _events(df: DataFrame, event: str | Column, at: str, quantity: Column | None = None, price: Column | None = None) -> DataFrame:
    event = F.lit(event) if isinstance(event, str) else event
    nothing = lambda kind: F.lit(None).cast(kind)
    return df.select(
        "order_id", "symbol", "side", F.col(at).cast("timestamp").alias("at"), event.alias("event"),
        (nothing("long") if quantity is None else quantity.cast("long")).alias("quantity"), (nothing("double") if price is None else price.cast("double")).alias("price"),
    )


def asked(signals: DataFrame, strategy: str = "rule", quantity: int = 1) -> DataFrame:
    """An order for each non-zero signal (symbol, ts, signal; ``limit`` if there is such a column), named by symbol, time and strategy. One without a positive quantity is refused at birth."""
    side = F.when(F.col("signal") > 0, "BUY").otherwise("SELL")
    named = signals.where("signal != 0").withColumns({"order_id": F.concat_ws("/", "symbol", F.col("ts").cast("string"), F.lit(strategy)), "side": side})
    limit = F.col("limit") if "limit" in signals.columns else F.lit(None)
    born = _events(named, "new", "ts", F.lit(quantity), limit)
    return born.union(_events(named, "refuse", "ts")) if quantity <= 0 else born


def state(events: DataFrame) -> DataFrame:
    """One row an order: (order_id, symbol, side, at, quantity, limit, filled, average, status).

    Events count in order of time, at one time in the order new, change, fill, cancel. What comes after an order's end says nothing, and no
    order is filled beyond its quantity. A repeated ``new`` of one order says nothing either.
    """
    rank = F.array_position(F.array(*map(F.lit, ("new", "refuse", "change", "fill", "cancel"))), F.col("event"))
    order = Window.partitionBy("order_id").orderBy("at", rank, "quantity", "price")
    before, until = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda *names: F.col("event").isin(*names)
    d = events.withColumn("__ended", F.coalesce(F.max(F.when(is_(*ENDS), 1)).over(before), F.lit(0)) == 1)
    d = d.withColumn("__born", F.row_number().over(Window.partitionBy("order_id", "event").orderBy("at", "quantity", "price")))
    d = d.where(~F.col("__ended") & (~is_("new") | (F.col("__born") == 1)))
    d = d.withColumn("__asked", F.last(F.when(is_("new", "change"), F.col("quantity")), ignorenulls=True).over(until))
    d = d.withColumn("__limit", F.last(F.when(is_("new", "change"), F.col("price")), ignorenulls=True).over(until))
    # Fills up to the quantity asked for at their time.
    executed = F.when(is_("fill"), F.col("quantity")).otherwise(0)
    d = d.withColumn("__sum", F.sum(executed).over(until))
    d = d.withColumn("__upto", F.least("__sum", "__asked")).withColumn("__real", F.when(is_("fill"), F.greatest(F.col("__upto") - F.least(F.col("__sum") - executed, F.col("__asked")), F.lit(0))).otherwise(0))
    d = d.withColumn("__number", F.row_number().over(order))
    last = F.col("__number")
    out = d.groupBy("order_id").agg(
        F.first("symbol", ignorenulls=True).alias("symbol"), F.first("side", ignorenulls=True).alias("side"), F.min("at").alias("at"), F.max_by("__asked", last).alias("quantity"), F.max_by("__limit", last).alias("limit"),
        F.sum("__real").alias("filled"), F.try_divide(F.sum(F.col("__real") * F.col("price")), F.sum("__real")).alias("average"),
        F.max(F.when(is_("cancel"), 1).otherwise(0)).alias("__cancelled"), F.max(F.when(is_("refuse"), 1).otherwise(0)).alias("__refused"),
    )
    status = F.when(F.col("__refused") == 1, "REFUSED").when(F.col("filled") >= F.col("quantity"), "FILLED").when(F.col("__cancelled") == 1, "CANCELLED").when(F.col("filled") > 0, "PARTIAL").otherwise("NEW")
    return out.withColumn("status", status).drop("__cancelled", "__refused")


def still_open(events: DataFrame) -> DataFrame:
    return state(events).where(F.col("status").isin("NEW", "PARTIAL"))


def cancel(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events that cancel the orders named in ``ids`` (order_id, at), for those that are still open."""
    return _events(still_open(events).drop("at").join(ids.select("order_id", "at").dropDuplicates(["order_id"]), "order_id"), "cancel", "at")


def change(events: DataFrame, asked_for: DataFrame) -> DataFrame:
    """Events that change open orders as ``asked_for`` (order_id, at, quantity, price; NULL leaves a field as it is)."""
    now = still_open(events).select("order_id", "symbol", "side")
    return _events(now.join(asked_for, "order_id"), "change", "at", F.col("quantity"), F.col("price"))


def matched(events: DataFrame, bars: DataFrame, share: float = 0.1) -> DataFrame:
    """Fills of the open orders on the bars (symbol, ts, open, high, low, volume) after them: at most ``share`` of each bar's volume an order.

    An order without a limit fills at the bar's open; one with a limit at its limit, or at the open if that is better, on bars that reach it.
    """
    now = still_open(events).select("order_id", "symbol", "side", "at", (F.col("quantity") - F.col("filled")).alias("__left"), "limit")
    buy = F.col("side") == "BUY"
    reached = F.col("limit").isNull() | F.when(buy, F.col("low") <= F.col("limit")).otherwise(F.col("high") >= F.col("limit"))
    price = F.when(F.col("limit").isNull(), F.col("open")).otherwise(F.when(buy, F.least("open", "limit")).otherwise(F.greatest("open", "limit")))
    both = now.join(bars.withColumn("__ts", F.col("ts").cast("timestamp")), "symbol").where((F.col("__ts") > F.col("at")) & reached).withColumn("__can", F.floor(F.col("volume") * share))
    past = F.coalesce(F.sum("__can").over(Window.partitionBy("order_id").orderBy("__ts").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = both.withColumn("__now", F.least(F.col("__can"), F.col("__left") - past)).where("__now > 0")
    return _events(both, "fill", "__ts", F.col("__now"), price)


def append(events: DataFrame, path: str, number: int, stream: str = "hand") -> bool:
    """Write events as batch ``number`` of ``stream``. A batch that is there already isn't written again; whether it was written."""
    spark = events.sparkSession
    folder = f"{path}/stream={stream}/batch={number}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return False
    events.write.mode("overwrite").parquet(folder)  # what a lost run left is replaced
    return True


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All events written so far."""
    return spark.read.schema(EVENTS).option("recursiveFileLookup", "true").parquet(path)


def placed(signals: DataFrame, path: str, checkpoint: str, strategy: str = "rule", quantity: int = 1, late: str = "1 day", every: str = "20 seconds") -> StreamingQuery:
    """Write the orders of a stream of signals to a ledger, each order once.

    An order seen before (within ``late`` of the newest signal) is dropped by the stream's own state, and a batch that runs again by its
    number; the ledger is never read. ``strategy`` names the stream, so strategies share a ledger.
    """
    fresh = signals.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).where("signal != 0").dropDuplicates(["symbol", "ts"])

    def write(batch: DataFrame, number: int) -> None:
        append(asked(batch, strategy, quantity), path, number, strategy)

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
