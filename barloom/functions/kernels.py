"""Recurrences over time. Those that forget run in chunks with a warm-up; affine ones are composed in blocks; the others go bar by bar,
a symbol in one pass or, in a frame that is cut (``slices``), from guessed states that are then put right."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barloom.functions import slices
from barloom.functions.slices import MARKS, place
from barloom.functions.store import kept


def ewm(x: pd.Series, n: int) -> pd.Series:
    """Exponential mean with weight 2/(n+1); gaps weigh as time passed, and repeat the last value."""
    return x.ewm(alpha=2 / (n + 1), adjust=False).mean()


def memory_of(n: int) -> int:
    """Rows after which an exponential mean of length n has forgotten all but 1e-18 of what was before."""
    return math.ceil(-math.log(1e-18) / -math.log(1 - 2 / (n + 1))) if n > 1 else 1


def fading(df: DataFrame, halo: int, fn: Callable[[pd.DataFrame], dict[str, pd.Series]], outs: list[str], chunk: int = 100_000) -> DataFrame:
    """Append the columns ``outs`` of ``fn`` (a symbol's bars in time order in, columns out), for recurrences that forget.

    A symbol is cut into chunks of ``chunk`` rows; each is computed with the ``halo`` rows before it, so that a long
    series is the work of many tasks; a frame that is cut is taken by its slices instead. Results differ from those of one pass by what ``halo`` rows leave of the past.
    """
    if slices.is_cut(df):
        return slices.over(df, lambda d: fading(d, halo, fn, outs, chunk), halo)
    chunk = max(chunk, halo)
    schema = StructType([*df.schema.fields, *[StructField(c, DoubleType()) for c in outs]])
    rows = df.withColumn("__rn", place(df) - (F.col("__first") if "__first" in df.columns else 0)).withColumn("__own", F.floor(F.col("__rn") / chunk))
    late = F.col("__rn") >= (F.col("__own") + 1) * chunk - halo
    rows = rows.withColumn("__chunk", F.explode(F.when(late, F.array(F.col("__own"), F.col("__own") + 1)).otherwise(F.array(F.col("__own")))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__rn", ignore_index=True)
        if not (pdf["__own"] == pdf["__chunk"]).any():  # only rows that warm up a chunk that isn't there
            return pd.DataFrame(columns=[f.name for f in schema]).astype({c: "float64" for c in outs})
        got = fn(pdf)
        out = pdf.assign(**{c: got[c].astype("float64") for c in outs})
        return out.loc[out["__own"] == out["__chunk"], [f.name for f in schema]]

    return rows.groupBy("symbol", "__chunk").applyInPandas(run, schema)


def scan(df: DataFrame, fn: Callable[[pd.DataFrame], dict], outs: list[str]) -> DataFrame:
    """Append the columns ``outs`` of ``fn`` over each symbol in one pass, for recurrences whose past never fades.

    A symbol's bars are the work of one task; symbols run side by side.
    """
    schema = StructType([*df.schema.fields, *[StructField(c, DoubleType()) for c in outs]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        got = fn(pdf)
        return pdf.assign(**{c: pd.Series(got[c], index=pdf.index, dtype="float64") for c in outs})[[f.name for f in schema]]

    return df.groupBy("symbol").applyInPandas(run, schema)


Step = Callable[[tuple | None, tuple], tuple[tuple, tuple]]


def path(step: Step, bars: Iterable[tuple]) -> list[tuple]:
    """The values that ``step`` gives along ``bars``, from the first on."""
    state, out = None, []
    for bar in bars:
        state, value = step(state, bar)
        out.append(value)
    return out


def walk(df: DataFrame, inputs: list[str], step: Step, outs: list[str], warm: int = 500) -> DataFrame:
    """Append ``outs``: ``step`` takes the state (floats; None before the first bar) and the ``inputs`` of a bar, and gives the next state and the values.

    A symbol's bars are the work of one task. In a cut frame its slices are: each is first run from a state guessed by ``warm``
    bars before it; where the state that a slice was entered with isn't the one that the slice before it was left with, it runs again
    from that one, until all agree. So results are those of one pass, whatever the guesses. Only states come back from these runs.
    """
    schema = StructType([*df.schema.fields, *[StructField(c, DoubleType()) for c in outs]])

    def through(p: pd.DataFrame, state: tuple | None) -> tuple[tuple | None, list[tuple]]:
        values = []
        for bar in zip(*(p[c].tolist() for c in inputs)):
            state, value = step(state, bar)
            values.append(value)
        return state, values

    def appended(p: pd.DataFrame, values: list[tuple]) -> pd.DataFrame:
        got = list(zip(*values)) if values else [()] * len(outs)
        return p.assign(**{c: pd.Series(v, index=p.index, dtype="float64") for c, v in zip(outs, got)})[[f.name for f in schema]]

    if not slices.is_cut(df):

        def run(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("ts", ignore_index=True)
            return appended(p, through(p, None)[1])

        return df.groupBy("symbol").applyInPandas(run, schema)

    states = "symbol string, __slice long, entry array<double>, exit array<double>"
    listed = lambda state: None if state is None else [float(x) for x in state]

    def guess(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("__row", ignore_index=True)
        entry = through(p[~p["__mine"]], None)[0]
        own = p[p["__mine"]]
        return pd.DataFrame({"symbol": own["__name"].iloc[:1], "__slice": own["__slice"].iloc[:1], "entry": [listed(entry)], "exit": [listed(through(own, entry)[0])]})

    def again(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("__row", ignore_index=True)
        entry = p["__entry"].iloc[0]
        entry = None if entry is None else tuple(entry)
        return pd.DataFrame({"symbol": [key[0]], "__slice": [key[1]], "entry": [listed(entry)], "exit": [listed(through(p, entry)[0])]})

    def final(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("__row", ignore_index=True)
        entry = p["__entry"].iloc[0]
        return appended(p, through(p, None if entry is None else tuple(entry))[1])

    bars = df.select("symbol", "ts", *MARKS, *[c for c in inputs if c not in ("symbol", "ts")])
    known = kept(slices.neighbours(bars, warm).groupBy("symbol").applyInPandas(guess, states), "states")
    left = F.lag("exit").over(Window.partitionBy("symbol").orderBy("__slice"))
    while True:
        checked = known.withColumn("__entry", left)
        wrong = kept(checked.where(~F.col("entry").eqNullSafe(F.col("__entry"))).select("symbol", "__slice", "__entry"), "wrong")
        if not wrong.limit(1).count():
            break
        mended = bars.join(wrong, ["symbol", "__slice"]).groupBy("symbol", "__slice").applyInPandas(again, states)
        known = kept(known.join(wrong, ["symbol", "__slice"], "left_anti").unionByName(mended), "states")
    entries = known.select("symbol", "__slice", F.col("entry").alias("__entry"))
    return df.join(entries, ["symbol", "__slice"]).select(*[F.col(f"`{c}`") for c in df.columns], "__entry").groupBy("symbol", "__slice").applyInPandas(final, schema)


def affine(df: DataFrame, a: str, b: str, out: str, block: int = 4096) -> DataFrame:
    """Append ``out`` = a * (``out`` of the row before) + b, in blocks of rows that are the work of many tasks.

    The map of a whole block is composed from those of its rows; the maps of a symbol's blocks are folded in order, one row a
    block, and each block then starts from what the blocks before it give. A row with a = 0 starts anew from b; rows before
    the first such row (a and b NULL) are NULL.
    """
    rows = df.withColumn("__rn", place(df)).withColumn("__block", F.floor(F.col("__rn") / block))

    def through(p: pd.DataFrame, y: float) -> list[float]:
        got = []
        for x, z in zip(p[a].tolist(), p[b].tolist()):
            y = z if x == 0 else x * y + z
            got.append(y)
        return got

    def compose(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("__rn")
        x, z = 1.0, 0.0
        for u, v in zip(p[a].tolist(), p[b].tolist()):
            x, z = (0.0, v) if u == 0 else (u * x, u * z + v)
        return pd.DataFrame({"symbol": [p["symbol"].iloc[0]], "__block": [p["__block"].iloc[0]], "__a": [x], "__b": [z]})

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("__block")
        y, before = math.nan, []
        for x, z in zip(p["__a"].tolist(), p["__b"].tolist()):
            before.append(y)
            y = z if x == 0 else x * y + z
        return pd.DataFrame({"symbol": p["symbol"], "__block": p["__block"], "__y": before})

    maps = rows.select("symbol", "__rn", "__block", a, b).groupBy("symbol", "__block").applyInPandas(compose, "symbol string, __block long, __a double, __b double")
    carried = rows.join(maps.groupBy("symbol").applyInPandas(fold, "symbol string, __block long, __y double"), ["symbol", "__block"])
    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("__rn", ignore_index=True)
        return p.assign(**{out: through(p, float(p["__y"].iloc[0]))})[[f.name for f in schema]]

    done = carried.groupBy("symbol", "__block").applyInPandas(run, schema)
    return done.withColumn(out, F.when(~F.isnan(out), F.col(out)))
