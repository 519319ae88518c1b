"""Long series slice by slice give what one pass gives."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import kernels, slices
from barloom.functions.windows import by_time, rsum
from barloom.operators import extra, levels, momentum, trend, volatility, volume

SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def bars(spark):
    rng, rows = random.Random(6), []
    for symbol, n in (("A", 3000), ("B", 1), ("C", 40), ("D", 700)):
        at, price = datetime(2024, 1, 1), 100.0
        for k in range(n):
            # Half of D's bars come in one burst.
            at += timedelta(microseconds=5) if symbol == "D" and 100 < k < 450 else timedelta(minutes=rng.choice([1, 1, 5, 600]))
            price = max(5.0, price + rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]))
            rows.append((symbol, at, price, price + rng.random(), price - rng.random(), price + rng.uniform(-0.4, 0.4), float(rng.randint(1, 99))))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def cut(bars):
    return slices.cut(bars, rows=150).cache()


def same(got, want, column):
    a = {(r.symbol, r.ts): r[column] for r in got.select("symbol", "ts", column).collect()}
    b = {(r.symbol, r.ts): r[column] for r in want.select("symbol", "ts", column).collect()}
    assert a.keys() == b.keys()
    for k, v in b.items():
        assert (a[k] is None or a[k] != a[k]) == (v is None or v != v), (column, k)
        assert v is None or v != v or abs(a[k] - v) <= 1e-9 * (1 + abs(v)), (column, k, a[k], v)


def test_slices_number_all_rows(bars, cut):
    want = bars.withColumn("n", F.row_number().over(by_time()) - 1)
    same(cut.withColumn("n", F.col("__row")), want, "n")
    sizes = [tuple(r) for r in cut.groupBy("symbol", "__slice").agg(F.count("*"), F.min("__row"), F.max("__row")).collect()]
    assert sum(s[0] == "A" for s in sizes) >= 15 and all(n == hi - lo + 1 for _, _, n, lo, hi in sizes)
    assert max(n for s, _, n, *_ in sizes if s == "A") <= 300
    assert slices.whole(cut).columns == bars.columns


def test_windows_look_across_slices(bars, cut):
    for back in (20, 400):  # within the slice before, and over several
        fn = lambda d: d.withColumn("x", rsum("close", back))  # noqa: E731, B023
        same(slices.over(cut, fn, back), fn(bars), "x")
    ahead = lambda d: d.withColumn("x", F.lead("close", 170).over(by_time()))
    same(slices.over(bars, ahead, 0, 170, rows=150), ahead(bars), "x")
    assert slices.over(bars, ahead, 0, 170, rows=150).columns == [*bars.columns, "x"]


@pytest.mark.parametrize(
    "fn, columns",
    [
        (lambda d: trend.ema(d, 5), ["ema"]),
        (lambda d: trend.macd(d, 3, 6, 4), ["macd", "macd_signal"]),
        (lambda d: extra.vidya(d), ["vidya"]),
        (lambda d: extra.frama(d), ["frama"]),
        (volume.obv, ["obv"]),
        (volume.adline, ["adline"]),
        (volume.pvt, ["pvt"]),
        (lambda d: volume.cdv(d), ["cdv"]),
        (trend.parabolic_sar, ["psar"]),
        (extra.supertrend, ["supertrend", "supertrend_direction"]),
        (extra.instantaneous_trendline, ["it"]),
        (extra.mcginley_dynamic, ["mcginley"]),
        (lambda d: levels.zigzag(d, 2.0), ["zigzag"]),
    ],
)
def test_operators_know_a_cut_frame(bars, cut, fn, columns):
    got, want = fn(cut).cache(), fn(bars).cache()
    assert "__slice" in got.columns
    for c in columns:
        same(got, want, c)


def test_any_operator_of_bounded_memory(bars):
    for fn, back, c in ((lambda d: volatility.bbands(d, 20), 20, "bb_upper"), (lambda d: momentum.cci(d, 20), 20, "cci"), (lambda d: trend.ichimoku(d), 80, "span_b")):
        want = fn(bars)
        c = c if c in want.columns else want.columns[-1]
        same(slices.over(bars, fn, back, 30, rows=150), want, c)


def test_a_wrong_guess_is_put_right(bars, cut):
    """A walk that never forgets: every slice but the first is guessed wrong at first."""

    def go(state, bar):
        total = (state[0] if state else 0.0) + bar[0]
        return (total,), (total,)

    want = bars.withColumn("x", F.sum("volume").over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
    same(kernels.walk(cut, ["volume"], go, ["x"], warm=3), want, "x")


def test_last_values_cross_slices(bars):
    holes = bars.withColumn("v", F.when(F.col("volume") > 98, F.col("volume")))
    same(slices.latest(slices.cut(holes, rows=20), "v", "x"), slices.latest(holes, "v", "x"), "x")


def test_a_long_series_is_many_tasks(spark, tmp_path):
    """One symbol of three million bars: no task holds more than a slice, and the result is that of the plain window."""
    n = 3_000_000
    long = spark.range(n).select(F.lit("L").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0).alias("close"))
    long.repartition(16, "close").write.parquet(str(tmp_path / "long"))
    long = spark.read.parquet(str(tmp_path / "long"))
    cut = slices.cut(long, rows=100_000)
    assert cut.groupBy("__slice").count().agg(F.max("count")).first()[0] < 110_000
    got = slices.over(cut, lambda d: d.withColumn("x", rsum("close", 50)), 50)
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("long")
    checked = got.select(at.alias("id"), "__row", F.round("x", 3).alias("x")).where("id != __row").count()
    assert checked == 0
    want = long.withColumn("x", rsum("close", 50)).agg(F.sum(F.round("x", 3)), F.count("x")).first()
    mine = got.agg(F.sum(F.round("x", 3)), F.count("x")).first()
    assert mine[1] == want[1] and abs(mine[0] - want[0]) < 1e-3


def test_empty_frames(bars):
    none = bars.where("false")
    assert slices.cut(none).count() == 0
    assert slices.over(none, lambda d: trend.ema(d, 5), 10).count() == 0
    assert trend.parabolic_sar(slices.cut(none)).count() == 0
