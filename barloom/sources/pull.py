"""Candles pulled from a service through a function of the caller, as a Spark data source for tables and streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from barloom.sources.bars import BARS

#: ``fetch(symbol, start, end)`` gives (ts, open, high, low, close, volume) of start < ts <= end in order of time; an end of None means until now.
Fetch = Callable[[str, datetime, datetime | None], Iterable[tuple]]


@dataclass
class Span(InputPartition):
    """What one task asks the service for: the candles of a symbol with start < ts <= end."""

    symbol: str
    start: datetime
    end: datetime | None


def spans(symbols: list[str], start: datetime, end: datetime | None, days: float | None) -> list[Span]:
    """A span for each symbol, cut every ``days`` if given and if it has an end."""
    if end is None or days is None:
        return [Span(s, start, end) for s in symbols]
    step, cuts = timedelta(days=days), [start]
    while cuts[-1] + step < end:
        cuts.append(cuts[-1] + step)
    return [Span(s, a, b) for s in symbols for a, b in zip(cuts, [*cuts[1:], end])]


def candle_source(fetch: Fetch, name: str = "candles", now: Callable[[], datetime] = datetime.now) -> type[DataSource]:
    """A data source to register with ``spark.dataSource.register``. Options: symbols (joined by commas), start and, for tables, end (ISO times);
    ``days`` cuts what a task asks for, ``delay`` (seconds) is how far a stream stays behind ``now``, for candles that the service still completes.

    Fetching is the work of tasks, one for each symbol and span of time; the driver only reads the clock. A stream's offset is the time up to
    which it has asked, so a restart asks for the rest, and a batch that runs again asks for the same candles; ``now`` may
    not go back between runs. Keys and addresses stay inside ``fetch``.
    """

    def options_of(options: dict) -> tuple[list[str], datetime, float | None]:
        days = options.get("days")
        return options["symbols"].split(","), datetime.fromisoformat(options["start"]), None if days is None else float(days)

    def rows(span: Span) -> Iterator[tuple]:
        for ts, *values in fetch(span.symbol, span.start, span.end):
            yield (span.symbol, ts, *(None if v is None else float(v) for v in values))

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.symbols, self.start, self.days = options_of(options)
            self.end = datetime.fromisoformat(options["end"]) if options.get("end") else None

        def partitions(self) -> list[InputPartition]:
            return spans(self.symbols, self.start, self.end, self.days)

        def read(self, partition: Span) -> Iterator[tuple]:
            return rows(partition)

    class Stream(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.symbols, self.start, self.days = options_of(options)
            self.delay = timedelta(seconds=float(options.get("delay", 0)))
            self.known = self.start

        def initialOffset(self) -> dict:
            return {"until": self.start.isoformat()}

        def latestOffset(self) -> dict:
            self.known = max(self.known, now() - self.delay)
            return {"until": self.known.isoformat()}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            a, b = (datetime.fromisoformat(x["until"]) for x in (start, end))
            return spans(self.symbols, a, b, self.days) if a < b else []

        def read(self, partition: Span) -> Iterator[tuple]:
            return rows(partition)

        def commit(self, end: dict) -> None:
            pass

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self):
            return BARS

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Stream(self.options)

    return Source
