"""Live bars: ticks to bars under a watermark, scans that keep a state per symbol, and a paper order sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators import trend

ORDERS = "order_id string, symbol string, ts timestamp, side string, quantity long, price double, status string"


def bars(ticks: DataFrame, key: str, ts: str, price: str, every: str = "1 hour", late: str = "10 minutes", tie: str | None = None) -> DataFrame:
    """Bars of a tick stream; ticks of one time are in order of ``tie``. A bar is final when the watermark passes it; ticks later than that are dropped."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    grouped = ticks.withWatermark(ts, late).groupBy(F.col(key).alias("symbol"), F.window(ts, every).alias("w"))
    out = grouped.agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").cast("double").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def walk(stream: DataFrame, step: Callable[[tuple | None, dict], tuple[tuple, float | None]], state: str, out: str, inputs: tuple[str, ...] = ("close",)) -> DataFrame:
    """(symbol, ts, ``out``) of a stream of bars: ``step`` takes the symbol's state (None at first; its fields are ``state``) and a bar, and gives the next state and a value.

    A symbol's state and the time of its last bar are all that is kept. Bars are taken in order of time: one that isn't later than the last of its symbol
    gives nothing, as it can't change what has been said.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now, last = (tuple(held.get[:-1]), held.get[-1]) if held.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable").drop_duplicates("ts")
        rows = (rows if last is None else rows[rows["ts"] > last]).reset_index(drop=True)
        if rows.empty:
            return
        values = []
        for bar in rows[list(inputs)].to_dict("records"):
            now, value = step(now, bar)
            values.append(value)
        held.update((*now, rows["ts"].iloc[-1].to_pydatetime()))
        yield pd.DataFrame({"symbol": key[0], "ts": rows["ts"], out: pd.Series(values, dtype="float64")})

    return stream.groupBy("symbol").applyInPandasWithState(run, f"symbol string, ts timestamp, {out} double", f"{state}, last timestamp", "append", GroupStateTimeout.NoTimeout)


def ema(stream: DataFrame, n: int = 14, price: str = "close") -> DataFrame:
    """Exponential mean of a stream of bars: one number of state a symbol."""
    weight = 2 / (n + 1)

    def step(state: tuple | None, bar: dict) -> tuple[tuple, float]:
        value = float(bar[price]) if state is None else (1 - weight) * state[0] + weight * bar[price]
        return (float(value),), value

    return walk(stream, step, "value double", "ema", (price,))


def parabolic_sar(stream: DataFrame, start: float = 0.02, pace: float = 0.02, most: float = 0.2) -> DataFrame:
    """The stop of ``trend.parabolic_sar`` on a stream: its state is the stop, the extreme, the speed, the side and the last two bars."""

    go = trend.sar_walk(start, pace, most)

    def step(state: tuple | None, bar: dict) -> tuple[tuple, float]:
        now, (stop,) = go(state, (float(bar["high"]), float(bar["low"])))
        return now, stop

    fields = "stop double, extreme double, speed double, up double, h1 double, l1 double, h2 double, l2 double"
    return walk(stream, step, fields, "psar", ("high", "low"))


def zigzag(stream: DataFrame, percent: float = 5.0) -> DataFrame:
    """The turns of ``levels.zigzag`` on a stream: its state is the last turn."""

    def step(state: tuple | None, bar: dict) -> tuple[tuple, float | None]:
        close = float(bar["close"])
        if state is None or state[0] and abs(close / state[0] - 1) * 100 > percent:
            return (close,), close
        return state, None

    return walk(stream, step, "anchor double", "zigzag")


def paper_orders(signals: DataFrame, path: str, checkpoint: str, quantity: int = 1, every: str = "20 seconds", strategy: str = "rule") -> StreamingQuery:
    """Write one order for each non-zero signal to a Parquet table; a signal that was seen before writes none.

    Orders are named by symbol, time and strategy, so a batch that runs again writes the same names and is sorted out.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.where("signal != 0").select(
            F.concat_ws("/", "symbol", F.col("ts").cast("string"), F.lit(strategy)).alias("order_id"),
            "symbol", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("signal") > 0, "BUY").otherwise("SELL").alias("side"), F.lit(quantity).cast("long").alias("quantity"), F.col("close").alias("price"), F.lit("FILLED").alias("status"),
        ).dropDuplicates(["order_id"])
        first = new.agg(F.min("ts")).first()[0]
        if first is None:
            return
        old = spark.read.schema(ORDERS).parquet(path).where(F.col("ts") >= F.lit(first)).select("order_id")  # an order's name holds its time
        new.join(old, "order_id", "left_anti").write.mode("append").parquet(path)

    signals.sparkSession.createDataFrame([], ORDERS).write.mode("append").parquet(path)  # so that there is a table
    return signals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def amended(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """Orders after their changes (order_id, at, quantity, price, status; a NULL leaves a field as it is), each field by its last change."""
    last = changes.groupBy("order_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"__{c}") for c in ("quantity", "price", "status")])
    both = orders.join(last, "order_id", "left")
    return both.withColumns({c: F.coalesce(f"__{c}", c) for c in ("quantity", "price", "status")}).select(orders.columns)


def cancelled(orders: DataFrame, ids: DataFrame) -> DataFrame:
    """Orders with those named in ``ids`` (order_id) cancelled, unless they are filled."""
    named = ids.select("order_id", F.lit(True).alias("__named")).distinct()
    stop = F.coalesce("__named", F.lit(False)) & (F.col("status") != "FILLED")
    return orders.join(named, "order_id", "left").withColumn("status", F.when(stop, "CANCELLED").otherwise(F.col("status"))).select(orders.columns)


def order_status(orders: DataFrame, order_id: str) -> DataFrame:
    return orders.where(F.col("order_id") == order_id)


def flatten(orders: DataFrame) -> DataFrame:
    """The orders that would close all open positions: the other side of each symbol's sum."""
    net = orders.groupBy("symbol").agg(F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))).alias("net")).where("net != 0")
    return net.select("symbol", F.when(F.col("net") > 0, "SELL").otherwise("BUY").alias("side"), F.abs("net").alias("quantity"))
