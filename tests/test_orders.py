"""Orders with a life: ledger, fills in part, changes, cancelling, batches that run again."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from barloom.streaming import orders

T = datetime(2024, 1, 1)
at = lambda h: T + timedelta(hours=h)


def events(spark, rows):
    return spark.createDataFrame([(i, "A", "BUY", at(h), e, q, p) for i, h, e, q, p in rows], orders.EVENTS)


def states(df):
    return {r.order_id: (r.status, r.quantity, r.filled, r.average) for r in orders.state(df).collect()}


def test_what_events_make_of_orders(spark):
    got = states(
        events(
            spark,
            [
                ("new", 0, "new", 5, None),
                ("part", 0, "new", 5, None), ("part", 1, "fill", 2, 10.0),
                ("full", 0, "new", 5, None), ("full", 1, "fill", 2, 10.0), ("full", 2, "fill", 3, 20.0),
                ("over", 0, "new", 5, None), ("over", 1, "fill", 4, 10.0), ("over", 2, "fill", 4, 20.0),
                ("gone", 0, "new", 5, None), ("gone", 1, "fill", 1, 10.0), ("gone", 2, "cancel", None, None), ("gone", 3, "fill", 4, 10.0),
                ("late", 0, "new", 5, None), ("late", 1, "fill", 5, 10.0), ("late", 2, "cancel", None, None),
                ("bad", 0, "new", 0, None), ("bad", 0, "refuse", None, None), ("bad", 1, "fill", 1, 1.0),
                ("less", 0, "new", 5, None), ("less", 1, "fill", 2, 10.0), ("less", 2, "change", 2, None),
                ("more", 0, "new", 2, None), ("more", 1, "change", 6, 9.0), ("more", 2, "fill", 4, 9.0), ("more", 2, "new", 99, None),
            ],
        )
    )
    assert got == {
        "new": ("NEW", 5, 0, None), "part": ("PARTIAL", 5, 2, 10.0), "full": ("FILLED", 5, 5, 16.0), "over": ("FILLED", 5, 5, 12.0), "gone": ("CANCELLED", 5, 1, 10.0),
        "late": ("FILLED", 5, 5, 10.0), "bad": ("REFUSED", 0, 0, None), "less": ("FILLED", 2, 2, 10.0), "more": ("PARTIAL", 6, 4, 9.0),
    }


def test_fills_changes_and_cancelling(spark, tmp_path):
    path = str(tmp_path / "ledger")
    signals = spark.createDataFrame([("A", at(0), 1, None), ("B", at(0), -1, 20.0), ("C", at(0), 0, None)], "symbol string, ts timestamp, signal int, limit double")
    assert orders.append(orders.asked(signals, "s", 30), path, 0) and not orders.append(orders.asked(signals, "s", 30), path, 0)
    all_ = lambda: orders.ledger(spark, path)
    bars = spark.createDataFrame([(s, at(h), o, o + 1, o - 1, 100.0) for s, h, o in [("A", 0, 5.0), ("A", 1, 6.0), ("A", 2, 7.0), ("B", 1, 18.0), ("B", 2, 19.5), ("B", 3, 25.0)]], "symbol string, ts timestamp, open double, high double, low double, volume double")
    orders.append(orders.matched(all_(), bars, 0.1), path, 1)
    got = states(all_())
    a, b = f"A/{at(0)}/s", f"B/{at(0)}/s"
    assert got == {a: ("PARTIAL", 30, 20, 6.5), b: ("PARTIAL", 30, 20, (20.0 + 25.0) / 2)}
    asked = spark.createDataFrame([(b, at(4), 22, None)], "order_id string, at timestamp, quantity long, price double")
    orders.append(orders.change(all_(), asked), path, 2)
    orders.append(orders.matched(all_(), spark.createDataFrame([("B", at(5), 30.0, 31.0, 29.0, 100.0)], bars.schema)), path, 3)
    ids = spark.createDataFrame([(a, at(6)), (b, at(6))], "order_id string, at timestamp")
    orders.append(orders.cancel(all_(), ids), path, 4)
    assert states(all_()) == {a: ("CANCELLED", 30, 20, 6.5), b: ("FILLED", 22, 22, (20.0 * 10 + 25.0 * 10 + 30.0 * 2) / 22)}
    assert orders.still_open(all_()).count() == 0


def test_orders_of_a_stream_are_written_once(spark, tmp_path):
    schema = "symbol string, ts timestamp, signal int"
    path, out, check = (str(tmp_path / x) for x in ("in", "ledger", "c"))
    for k in range(3):  # the same signals, and a restart, each time
        spark.createDataFrame([("A", at(0), 1), ("A", at(1), 0), ("B", at(k), -1)], schema).coalesce(1).write.mode("append").parquet(path)
        q = orders.placed(spark.readStream.schema(schema).parquet(path), out, check, every="0 seconds")
        q.processAllAvailable()
        q.stop()
    got = orders.state(orders.ledger(spark, out))
    assert sorted((r.symbol, r.at.hour, r.status) for r in got.collect()) == [("A", 0, "NEW"), ("B", 0, "NEW"), ("B", 1, "NEW"), ("B", 2, "NEW")]
    assert orders.ledger(spark, out).count() == 4
    # A batch that runs again writes nothing, one that was cut off is written again.
    folder = tmp_path / "ledger" / "stream=rule" / "batch=0"
    before = sorted(f.name for f in folder.iterdir())
    again = orders.asked(spark.createDataFrame([("A", at(0), 1)], schema))
    assert not orders.append(again, out, 0, "rule") and sorted(f.name for f in folder.iterdir()) == before
    (folder / "_SUCCESS").unlink()
    assert orders.append(again, out, 0, "rule")
    assert orders.cancel(orders.ledger(spark, out), orders.ledger(spark, out).select("order_id", F.col("at"))).count() == 3
