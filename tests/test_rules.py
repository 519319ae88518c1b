"""Signals from a stream equal those of the batch, after a restart too."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import signals, trend, volatility, volume
from barloom.streaming import rules

SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


@pytest.fixture()
def rocks(spark):
    spark.conf.set(rules.NEEDED, rules.PROVIDER)
    yield
    spark.conf.unset(rules.NEEDED)


def made(n=400):
    rng, rows = random.Random(2), []
    for symbol in "AB":
        price = 50.0
        for k in range(n):
            price = max(5, price + rng.choice([-2, -1, 0, 1, 2]) + (1.5 if k % 60 < 30 else -1.5))
            low, high = price - rng.random(), price + rng.random()
            rows.append((symbol, datetime(2024, 1, 1) + timedelta(hours=k), price, high + 0.2, low - 0.2, rng.uniform(low, high), float(rng.randint(1, 50))))
    return rows


def read(spark, out):
    return {(r.symbol, r.ts): r for r in spark.read.parquet(out).where("status = 'bar'").collect()}


def test_signals_of_a_stream_equal_the_batch(spark, rocks, tmp_path):
    rows = made()
    path, out, check = (str(tmp_path / x) for x in ("in", "out", "c"))
    for part in range(4):  # a restart after each part
        some = [r for r in rows if 100 * part <= (r[1] - datetime(2024, 1, 1)).total_seconds() / 3600 < 100 * (part + 1)]
        late = [r for r in rows if r[1] == datetime(2024, 1, 1) + timedelta(hours=100 * part - 3)]  # seen before: says nothing
        random.Random(part).shuffle(some)
        spark.createDataFrame(some + late, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        q = rules.signals(spark.readStream.schema(SCHEMA).parquet(path), "200 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        q.processAllAvailable()
        q.stop()
    bars = spark.createDataFrame(rows, SCHEMA)
    d = volatility.atr(volume.mfi(trend.t3ribbon(trend.macd(bars), (8, 13)), 14))
    want = {(r.symbol, r.ts): r for r in d.collect()}
    assert spark.read.parquet(out).where("status = 'bar'").count() == len(rows)
    got = read(spark, out)
    assert got.keys() == want.keys()
    for k, w in want.items():
        for c in rules.VALUES:
            assert (w[c] is None) == (got[k][c] is None or got[k][c] != got[k][c]), (k, c)
            assert w[c] is None or abs(w[c] - got[k][c]) < 1e-9 * (1 + abs(w[c])), (k, c)
    for name in rules.SIGNALS:
        said = {(r.symbol, r.ts): r.signal for r in getattr(signals, name)(bars).collect()}
        assert {k: g[name] for k, g in got.items()} == said
    assert any(g[name] for g in got.values() for name in ("harris_t3", "mfi_turn"))


def test_silent_symbols_are_told_once(spark, rocks, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda s, h: (s, datetime(2024, 1, 1) + timedelta(hours=h), 1.0, 2.0, 0.5, 1.5, 3.0)
    parts = [[at("A", 0), at("B", 0)], [at("A", 10)], [at("A", 20)], [at("A", 30)]]
    q = None
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        q = q or rules.signals(spark.readStream.schema(SCHEMA).parquet(path), "1 hour", 12 * 3600 * 1000).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
    q.stop()
    silent = [(r.symbol, r.ts) for r in spark.read.parquet(out).where("status = 'silent'").collect()]
    assert silent == [("B", datetime(2024, 1, 1, 12))]
    assert spark.read.parquet(out).where(F.col("status") == "bar").count() == 5
