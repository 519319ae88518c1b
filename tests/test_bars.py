"""Properties of bars, kernels and scans on small hand-made series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.kernels import ewm, fading, memory_of
from barloom.operators import backtest, extra, levels, momentum, signals, trend, volatility
from barloom.sources import bars


def frame(spark, closes, symbol="A"):
    rows = [(symbol, (pd.Timestamp("2024-01-01") + pd.Timedelta(days=k)).to_pydatetime(), float(c), float(c) + 1, float(c) - 1, float(c), 10.0) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, bars.BARS)


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "ts").collect()]


def test_chunks_with_warm_up_equal_one_pass(spark):
    x = np.random.default_rng(1).normal(100, 5, 700)
    df = frame(spark, x)
    halo = memory_of(5)
    got = column(fading(df, halo, lambda p: {"e": ewm(p["close"], 5)}, ["e"], chunk=halo), "e")
    assert np.allclose(got, ewm(pd.Series(x), 5), rtol=1e-13)


def test_short_series_and_single_rows(spark):
    df = frame(spark, [5.0])
    assert column(momentum.rsi(df), "rsi") == [None]
    assert column(trend.ema(df), "ema") == [5.0]
    assert column(levels.zigzag(df), "zigzag") == [5.0]
    assert column(trend.parabolic_sar(df), "psar") == [4.0]


def test_constant_prices(spark):
    df = frame(spark, [7.0] * 40)
    assert set(column(momentum.rsi(df), "rsi")) == {None}
    assert set(column(extra.regression_channel(df), "reg_r2")) == {None}
    assert column(volatility.bbands(df), "bb_percent")[-1] is None


def test_symbols_do_not_mix(spark):
    a, b = frame(spark, range(1, 60)), frame(spark, range(60, 1, -1), "B")
    both = momentum.rsi(a.union(b))
    assert column(both.where("symbol = 'A'"), "rsi") == column(momentum.rsi(a), "rsi")


def test_later_rows_do_not_change_earlier_ones(spark):
    x = np.random.default_rng(2).normal(100, 5, 90)
    for fn, name in ((trend.macd, "macd_hist"), (momentum.stc, "stc"), (extra.supertrend, "supertrend"), (extra.frama, "frama"), (momentum.connors_rsi, "connors_rsi")):
        assert column(fn(frame(spark, x[:60])), name) == column(fn(frame(spark, x)), name)[:60]


def test_parabolic_sar_by_hand():
    high, low = [10, 11, 12, 9], [9, 10, 11, 7]
    # rises from 9, held back each time by the first low; then a low breaks it and the last high becomes the stop
    assert trend.sar_path(high, low, 0.02, 0.02, 0.2) == pytest.approx([9, 9, 9, 12])


def test_zigzag_turns():
    assert levels.zigzag_path([100, 106, 104, 95, 96, 110], 5) == [100, 106, None, 95, None, 110]


def test_trades_take_target_stop_and_opposite(spark):
    df = frame(spark, [100, 100, 103, 100, 90, 90]).withColumn("signal", F.when(F.dayofmonth("ts").isin(1, 4), 1).otherwise(0))
    got = backtest.trades(df, take=0.02, stop=0.05, cost=0.0).orderBy("entry_ts").collect()
    assert [(r.side, round(r.ret, 4)) for r in got] == [(1, 0.02), (1, -0.05)]
    m = backtest.metrics(backtest.equity(backtest.trades(df, take=0.02, stop=0.05, cost=0.0))).first()
    assert m.n_trades == 2 and m.win_rate == 0.5


def test_trades_by_range_and_their_account(spark):
    """A fall on rising money flow opens a long, three mean ranges above its entry close it; the account moves with it."""
    rng = np.random.default_rng(4)
    df = frame(spark, 100 + np.cumsum(rng.normal(0, 1, 200)))
    df = df.withColumn("volume", 10 + 5 * F.sin(F.dayofyear("ts").cast("double")))
    done = backtest.range_trades(df).orderBy("entry_ts").collect()
    other = backtest.range_trades(df, invert=True).collect()
    assert done and other and all(abs(r.ret - r.side * (r.exit / r.entry - 1)) < 1e-12 for r in [*done, *other])
    assert all(a.exit_ts < b.entry_ts for a, b in zip(done, done[1:]))
    path = backtest.account(df, backtest.range_trades(df)).orderBy("ts").collect()
    assert len(path) == 200 and path[-1].drawdown <= 0
    # From entry close to exit price along the bars: a long's account ends where the trade does.
    if all(r.side > 0 for r in done):
        assert path[-1].equity == pytest.approx(100_000 * np.prod([1 + r.ret for r in done]))
    m = backtest.performance(df, backtest.range_trades(df)).first()
    assert m.final_value == pytest.approx(path[-1].equity) and m.n_trades == len(done)
    assert m.sharpe == pytest.approx(m.annual_return / m.annual_volatility)


def test_affine_in_blocks_equals_one_pass(spark):
    from barloom.functions.kernels import affine

    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 0.7, 300), rng.normal(0, 1, 300)
    a[[20, 150]] = 0
    df = frame(spark, a)
    pairs = spark.createDataFrame([((pd.Timestamp("2024-01-01") + pd.Timedelta(days=k)).to_pydatetime(), *((None, None) if k < 20 else (float(a[k]), float(b[k])))) for k in range(300)], "ts timestamp_ntz, a double, b double")
    got = column(affine(df.join(pairs, "ts").select("symbol", "ts", "a", "b"), "a", "b", "y", block=7), "y")
    want, y = [], None
    for k in range(300):
        y = None if k < 20 else b[k] if a[k] == 0 else a[k] * y + b[k]
        want.append(y)
    assert got[:20] == [None] * 20 and np.allclose(got[20:], want[20:])


def test_latest_signal(spark):
    df = frame(spark, [1, 2]).withColumn("signal", F.lit(-1))
    assert [(r.ts.day, r.action) for r in signals.latest(df).collect()] == [(2, "SELL")]


def test_sources_refuse_missing_columns(spark):
    with pytest.raises(ValueError):
        bars.normalised(spark.range(3))


def test_csv_round_trip(spark, tmp_path):
    frame(spark, [1, 2, 3]).write.option("header", True).csv(str(tmp_path / "b"))
    assert column(bars.read_csv(spark, str(tmp_path / "b")), "close") == [1, 2, 3]


def test_csv_with_a_row_number_and_other_names(spark, tmp_path):
    (tmp_path / "f.csv").write_text(",datetime,Open,High,Low,Close,Volume,rsi\n0,2024-01-01 09:15:00,1,2,0.5,1.5,10,\n1,2024-01-02 09:15:00,1.5,2,1,NaN,0,50\n")
    df = bars.read_csv(spark, str(tmp_path / "f.csv"), "INFY")
    assert df.columns == [f.name for f in bars.BARS] and column(df, "close") == [1.5, None] and {r.symbol for r in df.collect()} == {"INFY"}
    assert column(bars.traded(df), "volume") == [10]


def test_instruments_from_json_and_back(spark, tmp_path):
    from barloom.sources import sinks

    rows = ['{"name": "NIFTY", "exch_seg": "NFO", "instrumenttype": "OPTIDX", "expiry": "27JUN2024", "strike": "100.5"}', '{"name": "X", "exch_seg": "NSE", "instrumenttype": "EQ", "expiry": null, "strike": "1"}']
    (tmp_path / "m.json").write_text("\n".join(rows))
    got = bars.instrument_master(spark, str(tmp_path / "m.json"), "NFO", ["OPTIDX"], ["NIFTY"])
    sinks.instruments(got, str(tmp_path / "out"))
    r = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(r) == 1 and r[0].strike == 100.5 and (r[0].expiry.month, r[0].expiry.day) == (6, 27)


def test_sequences_before_a_row(spark):
    from barloom.operators import labels

    got = labels.windows_before(labels.three_way(frame(spark, range(1, 15))), 3).orderBy("ts").collect()
    assert got[0].sequence == [1, 2, 3] and len(got) == 11


def test_results_are_written(spark, tmp_path):
    from barloom.sources import sinks

    df = frame(spark, [100, 103]).withColumn("signal", F.lit(1))
    done = backtest.trades(df)
    account = backtest.equity(done)
    sinks.results(done, account, backtest.metrics(account), str(tmp_path / "r"))
    assert all(spark.read.parquet(str(tmp_path / "r" / n)).count() == 1 for n in ("trades", "equity", "metrics"))


def test_replay_and_sinks(spark, tmp_path):
    from barloom.sources import replay, sinks

    path = str(tmp_path / "bars")
    frame(spark, range(1, 31)).union(frame(spark, range(1, 31), "B")).write.parquet(path)
    got = replay.candles(spark, path, "B", "2024-01-10 00:00:00", "2024-01-12 00:00:00")
    assert column(got, "close") == [10, 11, 12]
    assert column(replay.last_days(spark, path, "A", "2024-01-12 00:00:00", 3), "close") == [10, 11, 12]
    assert column(replay.with_warm_up(spark.read.parquet(path), "2024-01-29 00:00:00", 2), "close") == [27, 28, 29, 30] * 2
    sinks.features(got, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 3


def test_costed_accounts(spark):
    from barloom.functions import slices
    from barloom.operators import backtest

    def run(closes, sides, **given):
        rows = [("A", (pd.Timestamp("2024-01-01") + pd.Timedelta(days=k)).to_pydatetime(), c, s) for k, (c, s) in enumerate(zip(closes, sides))]
        df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, signal int")
        out = [(r.cash, r.units, r.equity) for r in backtest.costed(df, **given).orderBy("ts").collect()]
        cut = [(r.cash, r.units, r.equity) for r in backtest.costed(slices.cut(df, 2), **given).orderBy("ts").collect()]
        assert out == cut
        return out

    plain = {"commission": 0.0, "slippage": 0.0, "cash": 100.0}
    assert run([10.0, 10.0, 20.0, 5.0], [0, 1, -1, None], size=0.5, **plain) == [(100, 0, 100), (50, 5, 100), (225, -3.75, 150), (225, -3.75, 206.25)]
    # A short that costs more than there is ends the account.
    assert run([10.0, 30.0, 10.0, 10.0], [-1, 0, 1, -1], size=1.0, **plain) == [(200, -10, 100), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
    # Costs: 1 % slippage, 2 % commission; a repeated signal and a missing close change nothing.
    got = run([100.0, None, 100.0, 100.0], [1, 1, 1, -1], size=0.5, commission=0.02, slippage=0.01, cash=1000.0)
    units = 500 * 0.98 / 101
    assert got[0] == pytest.approx((500, units, 500 + units * 100)) and got[1] == got[0] == got[2]
    free = 500 + units * 99 * 0.98
    assert got[3] == pytest.approx((free + free * 0.5 * 0.96, -free * 0.5 * 0.98 / 99, free + free * 0.5 * 0.96 - free * 0.5 * 0.98 / 99 * 100))
