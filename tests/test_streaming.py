"""Streams give what the batch gives."""

from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from barloom.functions.kernels import ewm
from barloom.operators import levels, trend
from barloom.sources import bars
from barloom.streaming import live



def test_ema_of_a_stream(spark, tmp_path):
    rows = [("A", (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=k)).to_pydatetime(), float(k * k % 17)) for k in range(30)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    path = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[max(0, 10 * k - 2) : 10 * k + 10], df.schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    q = live.ema(stream, 5).writeStream.format("memory").queryName("ema_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = [r.ema for r in spark.table("ema_out").orderBy("ts").collect()]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, ewm(pd.Series([r[2] for r in rows]), 5)))


def test_bars_of_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "in")
    events.select("event_type", "ts", "value").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("event_type string, ts timestamp, value double").parquet(path)
    q = live.bars(stream, "event_type", "ts", "value", "4 hours").writeStream.format("memory").queryName("bars_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in bars.by_type(spark, sf).collect()}
    got = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in spark.table("bars_out").collect()}
    assert got == want


def test_scans_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rows = [(s, (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=k)).to_pydatetime(), 100.0 + 9 * ((k * k * 7 + d) % 17), 90.0 + (k * 5 + d) % 13, 95.0 + (k * k + d) % 11) for s, d in (("A", 0), ("B", 3)) for k in range(30)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, high double, low double, close double")
    path = str(tmp_path / "in")
    for k in range(3):
        df.where(F.hour("ts").between(8 * k, 8 * k + 7)).where("ts < timestamp'2024-01-02'").coalesce(1).write.mode("append").parquet(path)
    batch = df.where("ts < timestamp'2024-01-02'")
    for name, of_stream, of_batch in (("psar", live.parabolic_sar, trend.parabolic_sar), ("zigzag", live.zigzag, levels.zigzag)):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)
        q = of_stream(stream).writeStream.format("memory").queryName(f"{name}_out").outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        got = {(r.symbol, r.ts): r[name] for r in spark.table(f"{name}_out").collect()}
        want = {(r.symbol, r.ts): r[name] for r in of_batch(batch).collect()}
        assert len(got) == 48 and all(got[k] == v or got[k] != got[k] and (v is None or v != v) or got[k] is None and (v is None or v != v) for k, v in want.items())


def test_late_ticks_are_dropped_and_bars_are_final(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    path = str(tmp_path / "in")
    schema = "event_id long, event_type string, ts timestamp, value double"
    parts = [[(1, "a", at(1, 0), 5.0), (3, "a", at(1, 30), 9.0), (2, "a", at(1, 30), 7.0)], [(4, "a", at(3, 0), 6.0)], [(5, "a", at(1, 40), 99.0), (6, "a", at(5, 0), 1.0)], [(7, "a", at(8, 0), 1.0)]]
    def batches(stream):
        return live.bars(stream, "event_type", "ts", "value", "1 hour", "10 minutes", "event_id").writeStream.format("memory").queryName("late_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()

    q = None
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        q = q or batches(spark.readStream.schema(schema).parquet(path))
        q.processAllAvailable()
    q.stop()
    got = {r.ts.hour: (r.open, r.high, r.close, r.volume) for r in spark.table("late_out").collect()}
    assert got[1] == (5.0, 9.0, 9.0, 3.0) and got[3] == (6.0, 6.0, 6.0, 1.0) and 8 not in got


def test_orders_change_and_are_cancelled(spark):
    orders = spark.createDataFrame([(k, "A", datetime(2024, 1, 1), "BUY", 1, 10.0, s) for k, s in (("x", "OPEN"), ("y", "OPEN"), ("z", "FILLED"))], live.ORDERS)
    changes = spark.createDataFrame([("x", 1, 5, None, None), ("x", 2, None, 11.0, None), ("x", 3, 7, None, None)], "order_id string, at int, quantity long, price double, status string")
    got = {r.order_id: (r.quantity, r.price) for r in live.amended(orders, changes).collect()}
    assert got == {"x": (7, 11.0), "y": (1, 10.0), "z": (1, 10.0)}
    ids = spark.createDataFrame([("y",), ("z",)], "order_id string")
    assert {r.order_id: r.status for r in live.cancelled(orders, ids).collect()} == {"x": "OPEN", "y": "CANCELLED", "z": "FILLED"}
    assert live.order_status(orders, "x").count() == 1


def test_orders_are_written_once(spark, tmp_path):
    rows = [("A", datetime(2024, 1, 1), 10.0, 1), ("A", datetime(2024, 1, 2), 11.0, 0)]
    schema = "symbol string, ts timestamp, close double, signal int"
    path, out = str(tmp_path / "in"), str(tmp_path / "orders")
    for _ in range(2):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        q = live.paper_orders(spark.readStream.schema(schema).parquet(path), out, str(tmp_path / "c"), every="0 seconds")
        q.processAllAvailable()
        q.stop()
    orders = spark.read.parquet(out)
    assert orders.count() == 1
    assert live.flatten(orders).first().side == "SELL"


def test_pulled_candles_as_table_and_stream(spark, tmp_path):
    from barloom.sources import pull

    clock = tmp_path / "clock"  # read in the driver's Python at each trigger

    def fetch(symbol, start, end):
        from pyspark import TaskContext

        days = (datetime(2024, 1, k) for k in range(1, 31))
        return [(d, 1.0, 2.0, 0.5, d.day + (symbol == "B"), float(TaskContext.get() is not None)) for d in days if start < d and (end is None or d <= end)]

    spark.dataSource.register(pull.candle_source(fetch, now=lambda: datetime.fromisoformat(clock.read_text())))
    options = {"symbols": "A,B", "start": "2024-01-02T00:00:00"}
    table = spark.read.format("candles").options(**options, end="2024-01-04T00:00:00").load()
    assert table.columns == [f.name for f in bars.BARS]
    assert sorted((r.symbol, r.ts.day, r.close) for r in table.collect()) == [("A", 3, 3.0), ("A", 4, 4.0), ("B", 3, 4.0), ("B", 4, 5.0)]
    parts = spark.read.format("candles").options(**options, end="2024-01-09T00:00:00", days="2").load()
    assert parts.rdd.getNumPartitions() == 8 and parts.count() == 14
    out = str(tmp_path / "out")
    for now in ("2024-01-05T12:00:00", "2024-01-11T00:00:00", "2024-01-11T02:00:00"):  # restarts, also without anything new
        clock.write_text(now)
        stream = spark.readStream.format("candles").options(**options, days="3", delay="3600").load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
    got = spark.read.parquet(out).collect()
    assert sorted((r.symbol, r.ts.day) for r in got) == [(s, d) for s in "AB" for d in range(3, 12)]
    assert {r.volume for r in got} == {1.0}  # fetched in tasks


def test_spans_of_time():
    from barloom.sources import pull

    day = lambda k: datetime(2024, 1, k)
    assert [(s.symbol, s.start, s.end) for s in pull.spans(["A"], day(1), day(4), 2)] == [("A", day(1), day(3)), ("A", day(3), day(4))]
    assert [(s.start, s.end) for s in pull.spans(["A", "B"], day(1), None, 2)] == [(day(1), None)] * 2
    assert [(s.start, s.end) for s in pull.spans(["A"], day(1), day(3), 2)] == [(day(1), day(3))]
