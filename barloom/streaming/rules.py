"""The rule signals on a stream of bars, with all that they need of the past in the state of their symbol.

A symbol's state is a handful of numbers (exponential means, the averaged open) and a ring of its last bars, raw and averaged. A bar
moves both on by one step, so its cost doesn't depend on how long the symbol has been followed. ``indicators`` and the signals equal those of
``trend``, ``volume``, ``volatility`` and ``signals`` over the same bars.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Bars that the longest window needs, and the one before.
RING = 29
PRICES = ("open", "high", "low", "close", "volume")
T3 = (8, 13)
VALUES = ("macd", "macd_signal", "mfi", "atr", "t3_8", "t3_13")
SIGNALS = ("macd_uo_tsv", "harris_t3", "mfi_turn")
FORM = f"symbol string, ts timestamp, status string, {', '.join(f'{c} double' for c in VALUES)}, {', '.join(f'{c} int' for c in SIGNALS)}"
NEEDED = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Means(list):
    """Exponential means in a fixed order; a fresh one takes its first value."""

    def start(self) -> None:
        self.at = 0

    def move(self, value: float, n: int) -> float:
        if self.at == len(self):
            self.append(value)
        else:
            weight = 2 / (n + 1)
            self[self.at] = (1 - weight) * self[self.at] + weight * value
        self.at += 1
        return self[self.at - 1]


class Series:
    """Indicators of one run of bars: exponential means and the last bars."""

    def __init__(self, means: list[float] = (), ring: list[tuple] = ()) -> None:
        self.means, self.ring = Means(means), deque(ring, RING)

    def back(self, k: int) -> tuple | None:
        return self.ring[-1 - k] if len(self.ring) > k else None

    def _sums(self, n: int, of) -> tuple[float, ...] | None:
        """Sums of ``of(bar, bar before)`` over the last n bars; None before there are n, or where one is missing."""
        if len(self.ring) < n:
            return None
        bars = list(self.ring)
        pairs = [of(bars[k], bars[k - 1] if k else None) for k in range(len(bars) - n, len(bars))]
        return None if any(p is None for p in pairs) else tuple(map(sum, zip(*pairs)))

    def money_flow(self, n: int) -> float | None:
        def flows(bar: tuple, last: tuple | None) -> tuple[float, float]:
            price = sum(bar[1:4]) / 3
            change = 0.0 if last is None else price - sum(last[1:4]) / 3
            return (price * bar[4] if change > 0 else 0.0), (price * bar[4] if change < 0 else 0.0)

        got = self._sums(n, flows)
        return None if got is None else 100 - 100 / (1 + (100.0 if got[1] == 0 else got[0] / got[1]))

    def ultimate(self) -> float | None:
        parts = [self._sums(k, lambda b, a: (b[3] - min(b[2], a[3] if a else b[2]), _range(b, a))) for k in (7, 14, 28)]
        if any(p is None or not p[1] for p in parts):
            return None
        return 100 * sum(w * p[0] / p[1] for w, p in zip((4, 2, 1), parts)) / 7

    def segment_volume(self) -> float | None:
        got = self._sums(13, lambda b, a: ((b[3] - a[3]) * b[4],) if a else None)
        return got and got[0]

    def interleaved(self) -> int:
        if len(self.ring) < 4:
            return 0
        h, lo = ([self.back(k)[i] for k in range(4)] for i in (1, 2))
        if h[0] > h[1] > lo[0] > h[2] > lo[1] > h[3] > lo[2] > lo[3]:
            return 1
        return -1 if h[0] < h[1] < lo[0] < h[2] < lo[1] < h[3] < lo[2] < lo[3] else 0

    def step(self, bar: tuple) -> dict[str, float | None]:
        last = self.back(0)
        self.ring.append(bar)
        m = self.means
        m.start()
        line = m.move(bar[3], 12) - m.move(bar[3], 26)
        out = {"macd": line, "macd_signal": m.move(line, 9), "atr": m.move(_range(bar, last), 14), "mfi": self.money_flow(14)}
        for n in T3:
            e = [bar[3]]
            for _ in range(6):
                e.append(m.move(e[-1], n))
            v = 0.7
            out[f"t3_{n}"] = -(v**3) * e[6] + (3 * v * v + 3 * v**3) * e[5] + (-6 * v * v - 3 * v - 3 * v**3) * e[4] + (1 + 3 * v + v**3 + 3 * v * v) * e[3]
        return out


def _range(bar: tuple, last: tuple | None) -> float:
    return max([bar[1] - bar[2], *([abs(bar[1] - last[3]), abs(bar[2] - last[3])] if last else [])])


def _round2(x: float) -> float:
    return round(x * 100) / 100


class Symbol:
    """A symbol's raw and averaged bars; ``step`` gives the values of the raw bars and the signals of the averaged ones."""

    def __init__(self, raw: Series | None = None, averaged: Series | None = None, held: list[float] | None = None) -> None:
        self.raw, self.averaged = raw or Series(), averaged or Series()
        self.held = held or []  # the averaged open and close, both T3 lines, money flow of the last two bars

    def step(self, bar: tuple) -> dict[str, float | int | None]:
        out = self.raw.step(bar)
        close = sum(bar[:4]) / 4
        first = not self.held
        mean = (bar[0] + bar[3]) / 2 if first else 0.5 * self.held[0] + 0.5 * self.held[1]
        got = self.averaged.step((_round2(mean), _round2(max(bar[1], mean, close)), _round2(min(bar[2], mean, close)), _round2(close), bar[4]))
        flow, uo, tsv = self.averaged.money_flow(10), self.averaged.ultimate(), self.averaged.segment_volume()
        nan = float("nan")
        lines, flows = ([nan, nan], [nan, nan]) if first else (self.held[2:4], self.held[4:6])
        known = uo is not None and tsv is not None
        over, under = got["macd"] > got["macd_signal"], got["macd"] < got["macd_signal"]
        out["macd_uo_tsv"] = (1 if over and uo > 70 and tsv > 0 else -1 if under and uo < 30 and tsv < 0 else 0) if known else 0
        side = self.averaged.interleaved()
        moves = [(got[f"t3_{n}"] - line) * side for n, line in zip(T3, lines)]
        out["harris_t3"] = side if side and any(x >= 0 for x in moves) else 0
        out["mfi_turn"] = 0
        if flow is not None and len(self.averaged.ring) > 2:
            c, m = [self.averaged.back(k)[3] for k in range(3)], [flow, *flows]
            out["mfi_turn"] = 1 if m[0] <= 40 and m[0] > m[1] > m[2] and c[0] < c[1] < c[2] else -1 if m[0] >= 60 and m[0] < m[1] < m[2] and c[0] > c[1] > c[2] else 0
        self.held = [mean, close, got["t3_8"], got["t3_13"], nan if flow is None else flow, flows[0]]
        return out


class Rules(StatefulProcessor):
    """Signals bar by bar; a symbol without bars for ``silent_ms`` of event time gives one row of status ``silent``."""

    def __init__(self, silent_ms: int) -> None:
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("numbers", "last timestamp, raw array<double>, averaged array<double>, held array<double>")
        self.rings = handle.getListState("rings", "averaged boolean, open double, high double, low double, close double, volume double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, now = None, Symbol()
        if self.numbers.exists():
            last, raw, averaged, held = self.numbers.get()
            rings: tuple[list, list] = ([], [])
            for is_averaged, *bar in self.rings.get():
                rings[is_averaged].append(tuple(bar))
            now = Symbol(Series(list(raw), rings[0]), Series(list(averaged), rings[1]), list(held))
        bars = pd.concat(list(rows)).dropna(subset=list(PRICES)).sort_values("ts", kind="stable").drop_duplicates("ts")
        if last is not None:
            bars = bars[bars["ts"] > last]  # what comes late can't change what has been said
        if bars.empty:
            return
        out = [{"symbol": key[0], "ts": ts, "status": "bar", **now.step(tuple(map(float, bar)))} for ts, *bar in bars[["ts", *PRICES]].itertuples(index=False)]
        last = bars["ts"].iloc[-1].to_pydatetime()
        self.numbers.update((last, list(now.raw.means), list(now.averaged.means), now.held))
        self.rings.put([(flag, *bar) for flag, series in ((False, now.raw), (True, now.averaged)) for bar in series.ring])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(bars["ts"].iloc[-1].timestamp() * 1000) + self.silent_ms)
        yield _framed(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield _framed([{"symbol": key[0], "ts": pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"), "status": "silent"}])

    def close(self) -> None:
        pass


def _framed(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["symbol", "ts", "status", *VALUES, *SIGNALS])
    return out.assign(**{c: out[c].astype("float64") for c in VALUES}, **{c: out[c].astype("float64").astype("Int32") for c in SIGNALS})


def signals(stream: DataFrame, late: str = "10 minutes", silent_ms: int = 3 * 24 * 3600 * 1000) -> DataFrame:
    """(symbol, ts, status, indicators, signals) of a stream of bars (symbol, ts, open, high, low, close, volume).

    Bars are taken in order of time; one that isn't later than the symbol's last bar, and one with a missing number, gives
    nothing. Needs the state store that ``PROVIDER`` names in the session's setting ``NEEDED``.
    """
    bars = stream.select("symbol", "ts", *PRICES).withWatermark("ts", late)
    return bars.groupBy("symbol").transformWithStateInPandas(Rules(silent_ms), FORM, "Append", "EventTime")
