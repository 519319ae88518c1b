"""Backtests: one position at a time for each symbol, trades, equity and metrics as DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.kernels import walk
from barloom.functions.slices import place
from barloom.functions.windows import by_time, flag, lag, sd, sma, true_range
from barloom.operators import trend, volume

TRADES = "symbol string, side int, entry_ts timestamp_ntz, exit_ts timestamp_ntz, entry double, exit double, bars int, ret double"


def trades(df: DataFrame, take: float = 0.005, stop: float = 0.003, cost: float = 0.0007, invert: bool = False, opposite: bool = True) -> DataFrame:
    """Trades of a frame with a ``signal``: in at the close of a signal bar, out at the target, the stop, or (``opposite``) an opposite signal.

    The position of a bar depends on that of the bar before, so a symbol is one pass; symbols run side by side. ``cost`` is
    taken at both ends. ``invert`` takes the other side of each signal. A position still open at the end is closed there.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        rows, side, start = [], 0, 0
        close, high, low = (pdf[c].tolist() for c in ("close", "high", "low"))
        signal = [(-s if invert else s) for s in pdf["signal"].fillna(0).astype(int).tolist()]
        ts = pdf["ts"].tolist()
        for k in range(len(pdf)):
            if side:
                entry = close[start]
                target, limit = entry * (1 + side * take), entry * (1 - side * stop)
                out = limit if (low[k] <= limit if side > 0 else high[k] >= limit) else target if (high[k] >= target if side > 0 else low[k] <= target) else None
                if out is None and (opposite and signal[k] == -side or k == len(pdf) - 1):
                    out = close[k]
                if out is not None:
                    rows.append((pdf["symbol"][0], side, ts[start], ts[k], entry, out, k - start, side * (out / entry - 1) - 2 * cost))
                    side = 0
            if not side and signal[k] and k < len(pdf) - 1:
                side, start = signal[k], k
        return pd.DataFrame(rows, columns=["symbol", "side", "entry_ts", "exit_ts", "entry", "exit", "bars", "ret"])

    return df.select("symbol", "ts", "high", "low", "close", "signal").groupBy("symbol").applyInPandas(run, TRADES)


def range_trades(df: DataFrame, n: int = 14, target: float = 3.0, stop: float = 2.0, low: float = 40, high: float = 60, cost: float = 0.0, invert: bool = False) -> DataFrame:
    """Trades of turns in money flow, with exits by the mean range at entry or by the MACD.

    In at the close: money flow (10) at most ``low`` and not falling for two bars while the close does not rise; mirrored at ``high``.
    Out at the close of a bar that is ``target`` ranges beyond the entry or ``stop`` ranges against it, or when the MACD is on the
    other side of its signal. A bar that closes a position opens none. ``invert`` takes the other side of each entry.
    """
    d = trend.macd(volume.mfi(df, 10)).withColumn("__tr", true_range()).withColumn("__atr", sma("__tr", n))
    m, c = [F.col("mfi"), lag("mfi"), lag("mfi", 2)], [F.col("close"), lag("close"), lag("close", 2)]
    up = (m[0] <= low) & (m[0] >= m[1]) & (m[1] >= m[2]) & (c[0] <= c[1]) & (c[1] <= c[2])
    down = (m[0] >= high) & (m[0] <= m[1]) & (m[1] <= m[2]) & (c[0] >= c[1]) & (c[1] >= c[2])
    d = d.withColumn("signal", flag(up) - flag(down & ~F.coalesce(up, F.lit(False))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        rows, side, start = [], 0, 0
        close, gap, atr, ts = pdf["close"].tolist(), (pdf["macd"] - pdf["macd_signal"]).tolist(), pdf["__atr"].tolist(), pdf["ts"].tolist()
        signal = [(-s if invert else s) for s in pdf["signal"].astype(int).tolist()]
        last = len(pdf) - 1
        for k in range(len(pdf)):
            if side:
                gain = side * (close[k] - close[start])
                if gain >= target * atr[start] or gain <= -stop * atr[start] or side * gap[k] < 0 or k == last:
                    rows.append((pdf["symbol"][0], side, ts[start], ts[k], close[start], close[k], k - start, side * (close[k] / close[start] - 1) - 2 * cost))
                    side = 0
            elif signal[k] and k < last and atr[k] == atr[k]:
                side, start = signal[k], k
        return pd.DataFrame(rows, columns=["symbol", "side", "entry_ts", "exit_ts", "entry", "exit", "bars", "ret"])

    return d.select("symbol", "ts", "close", "macd", "macd_signal", "__atr", "signal").groupBy("symbol").applyInPandas(run, TRADES)


def three_bar_signal(df: DataFrame) -> DataFrame:
    """``signal``: 1 if the high beats the last one, the low beats the high before that, and that high the last low; mirrored for -1. Begins on the fourth bar."""
    h, lo = F.col("high"), F.col("low")
    late = place(df) >= 3
    up = late & (h > lag("high")) & (lo > lag("high", 2)) & (lag("high", 2) > lag("low"))
    down = late & (h < lag("high")) & (lo < lag("high", 2)) & (lag("high", 2) < lag("low"))
    return df.withColumn("signal", flag(up) - flag(down))


def three_bar_trades(df: DataFrame, lengths: tuple[int, int] = (8, 13), take: float = 0.005, stop: float = 0.003, cost: float = 0.0) -> DataFrame:
    """Trades of ``three_bar_signal`` where one of two T3 lines slopes its way, held to the target or the stop (an opposite signal closes nothing)."""
    a, b = (f"t3_{n}" for n in lengths)
    d = trend.t3ribbon(three_bar_signal(df), lengths)
    way = lambda s: (s * (F.col(a) - lag(a)) > 0) | (s * (F.col(b) - lag(b)) > 0)
    d = d.withColumn("signal", F.when((F.col("signal") == 1) & way(1), 1).when((F.col("signal") == -1) & way(-1), -1).otherwise(0))
    return trades(d, take, stop, cost, opposite=False)


def equity(done: DataFrame, cash: float = 100_000.0) -> DataFrame:
    """The account of each symbol after each trade, and its fall from the highest so far."""
    w = Window.partitionBy("symbol").orderBy("exit_ts", "entry_ts").rowsBetween(Window.unboundedPreceding, 0)
    d = done.withColumn("equity", cash * F.exp(F.sum(F.ln(F.greatest(1 + F.col("ret"), F.lit(1e-12)))).over(w)))
    return d.withColumn("drawdown", F.col("equity") / F.greatest(F.max("equity").over(w), F.lit(cash)) - 1)


def account(bars: DataFrame, done: DataFrame, cash: float = 100_000.0, cost: float = 0.0) -> DataFrame:
    """The account of each symbol after each bar: (symbol, ts, bar_return, equity, drawdown).

    A position earns its side of each bar's change, from the close of its entry bar to its exit price; ``cost`` is paid on both of those bars.
    """
    ins = done.select("symbol", F.col("entry_ts").alias("ts"), F.col("side").alias("__in"))
    outs = done.select("symbol", F.col("exit_ts").alias("ts"), F.col("exit").alias("__out"))
    d = bars.select("symbol", "ts", "close").join(ins, ["symbol", "ts"], "left").join(outs, ["symbol", "ts"], "left")
    past = by_time().rowsBetween(Window.unboundedPreceding, -1)
    held = F.count("__in").over(past) > F.count("__out").over(past)
    change = sd(F.coalesce("__out", "close"), lag("close")) - 1
    d = d.withColumn("__r", F.when(held, F.last("__in", ignorenulls=True).over(past) * change).otherwise(0.0))
    paid = F.when(F.col("__in").isNotNull(), cost).otherwise(0.0) + F.when(F.col("__out").isNotNull(), cost).otherwise(0.0)
    d = d.withColumn("bar_return", F.coalesce(F.col("__r"), F.lit(0.0)) - paid)
    w = by_time().rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("equity", cash * F.exp(F.sum(F.ln(F.greatest(1 + F.col("bar_return"), F.lit(1e-12)))).over(w)))
    return d.withColumn("drawdown", F.col("equity") / F.greatest(F.max("equity").over(w), F.lit(cash)) - 1).select("symbol", "ts", "bar_return", "equity", "drawdown")


def costed(df: DataFrame, size: float = 1.0, commission: float = 0.0005, slippage: float = 0.0002, cash: float = 100_000.0) -> DataFrame:
    """Append ``cash``, ``units`` and ``equity``: the account of each symbol bar by bar, for a frame with a ``signal``.

    A signal of 1 buys if nothing or less is held, -1 sells if nothing or more is held; what was held the other way is closed first, so the position
    turns. A position takes ``size`` of the cash then free; purchases cost the close and ``slippage`` more, sales bring that much less, and
    ``commission`` is taken from both. What a short sale brings is cash. An account that is worth nothing or less ends: it stays at zero.
    Bars without a close or signal leave the position as it is. In a frame that is cut, slices are run side by side (``walk``).
    """

    def go(state: tuple | None, bar: tuple) -> tuple[tuple, tuple]:
        close, signal = bar
        free, units, last = state or (cash, 0.0, 0.0)
        if close is None or close != close:
            return (free, units, last), (free, units, free + units * last)
        price = close * (1 + slippage * signal) if signal == signal and signal is not None else close
        if signal in (1, -1) and signal * units <= 0:
            free += units * price - commission * abs(units) * price
            value = free * size
            units = signal * value * (1 - commission) / price if price else 0.0
            free -= units * price + value * commission
        equity = free + units * close
        if equity <= 0:
            free = units = equity = 0.0
        return (free, units, close), (free, units, equity)

    return walk(df, ["close", "signal"], go, ["cash", "units", "equity"])


def performance(bars: DataFrame, done: DataFrame, cash: float = 100_000.0, cost: float = 0.0, periods: float = 252.0) -> DataFrame:
    """One row a symbol: total and annualised return, annualised volatility and their quotient (Sharpe, without a riskless rate), worst fall and final value
    from the account after each bar (``periods`` bars a year), and the trades' number, win rate, mean win and loss, profit factor and days held."""
    steps = account(bars, done, cash, cost).groupBy("symbol").agg(
        F.max_by("equity", "ts").alias("final_value"), F.count("*").alias("__n"), (F.stddev_samp("bar_return") * F.sqrt(F.lit(periods))).alias("annual_volatility"), F.min("drawdown").alias("max_drawdown")
    )
    steps = steps.withColumn("total_return", F.col("final_value") / cash - 1)
    steps = steps.withColumn("annual_return", F.pow(F.col("final_value") / cash, periods / F.col("__n")) - 1).withColumn("sharpe", sd("annual_return", "annual_volatility"))
    win, loss = F.when(F.col("ret") > 0, F.col("ret")), F.when(F.col("ret") <= 0, F.col("ret"))
    seconds = F.unix_timestamp(F.col("exit_ts").cast("timestamp")) - F.unix_timestamp(F.col("entry_ts").cast("timestamp"))
    of_trades = done.groupBy("symbol").agg(
        F.count("*").alias("n_trades"), (F.count(win) / F.count("*")).alias("win_rate"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"),
        F.try_divide(F.sum(win), F.abs(F.sum(loss))).alias("profit_factor"), F.avg(seconds / 86400).alias("days_held"),
    )
    both = steps.drop("__n").join(of_trades, "symbol", "left")
    return both.withColumn("n_trades", F.coalesce("n_trades", F.lit(0)))


def metrics(account: DataFrame, cash: float = 100_000.0) -> DataFrame:
    """One row a symbol: total return, trades, win rate, mean win and loss, profit factor, worst fall between trades and bars held; ``performance`` goes by bars."""
    win, loss = F.when(F.col("ret") > 0, F.col("ret")), F.when(F.col("ret") <= 0, F.col("ret"))
    return account.groupBy("symbol").agg(
        (F.max_by("equity", F.struct("exit_ts", "entry_ts")) / cash - 1).alias("total_return"),
        F.count("*").alias("n_trades"),
        (F.count(win) / F.count("*")).alias("win_rate"),
        F.avg(win).alias("avg_win"),
        F.avg(loss).alias("avg_loss"),
        F.try_divide(F.sum(win), F.abs(F.sum(loss))).alias("profit_factor"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg("bars").alias("avg_bars"),
    )
