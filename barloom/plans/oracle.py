"""DuckDB SQL for the registered queries: bars and window phrases as text."""

from __future__ import annotations

W = "PARTITION BY symbol ORDER BY ts"
PRICES = "max({v}) AS high, min({v}) AS low, arg_max({v}, {t}) AS close, CAST(count(*) AS DOUBLE) AS volume"


def _bars(table: str, symbol: str, bucket: str, value: str, tie: str) -> str:
    return f"SELECT {symbol} AS symbol, {bucket} AS ts, arg_min({value}, {tie}) AS open, {PRICES.format(v=value, t=tie)} FROM {table} GROUP BY 1, 2"


BARS = {
    "hourly": _bars("events", "'ALL'", "time_bucket(INTERVAL '1 hour', ts)", "value", "ts"),
    "by_type": _bars("events", "event_type", "time_bucket(INTERVAL '4 hours', ts)", "value", "ts"),
    "daily_orders": _bars("orders", "o_orderpriority", "date_trunc('day', o_orderdate)::TIMESTAMP", "o_totalprice", "o_orderkey"),
    "market": _bars("orders", "'MARKET'", "date_trunc('day', o_orderdate)::TIMESTAMP", "o_totalprice", "o_orderkey"),
}


def L(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({W})" if k >= 0 else f"lead({x}, {-k}) OVER ({W})"


def O(f: str, x: str, a: int, b: int) -> str:  # noqa: E743
    """f over the rows from a to b against this one."""
    at = lambda k: "CURRENT ROW" if k == 0 else f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING"
    return f"{f}({x}) OVER ({W} ROWS BETWEEN {at(a)} AND {at(b)})"


def R(f: str, x: str, n: int) -> str:
    """f over the last n rows if all have values."""
    return f"(CASE WHEN {O('count', x, 1 - n, 0)} = {n} THEN {O(f, x, 1 - n, 0)} END)"


def D(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def CUM(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN sum({x}) OVER ({W} ROWS UNBOUNDED PRECEDING) END)"


def E(x: str, n: int) -> str:
    """Exponential mean of a column with values from some row on."""
    a = 2 / (n + 1)
    return f"(CASE WHEN {x} IS NOT NULL THEN list_reduce(list_filter(list({x}) OVER ({W} ROWS UNBOUNDED PRECEDING), lambda v: v IS NOT NULL), lambda p, q: p * (1 - {a!r}) + q * {a!r}) END)"


def EG(x: str, n: int) -> str:
    """Exponential mean of a column with gaps: they repeat the last value and weigh as time passed."""
    a = 2 / (n + 1)
    b = f"{1 - a!r}::DOUBLE"
    step = f"CASE WHEN now_.y IS NULL THEN {{'y': acc_.y, 'w': acc_.w * {b}}} WHEN acc_.y IS NULL THEN now_ ELSE {{'y': (acc_.w * {b} * acc_.y + {a!r}::DOUBLE * now_.y) / (acc_.w * {b} + {a!r}::DOUBLE), 'w': 1.0::DOUBLE}} END"
    return f"(list_reduce(list({{'y': ({x})::DOUBLE, 'w': 1.0::DOUBLE}}) OVER ({W} ROWS UNBOUNDED PRECEDING), lambda acc_, now_: {step})).y"


TP, HL2 = "(high + low + close) / 3", "(high + low) / 2"
TR = f"greatest(high - low, abs(high - {L('close')}), abs(low - {L('close')}))"
UP, DOWN = "greatest(coalesce(d, 0), 0)", "greatest(-coalesce(d, 0), 0)"
RN = {"rn": f"row_number() OVER ({W}) - 1"}


def rsi(x: str, n: int, out: str) -> list[dict]:
    return [
        {"d": f"{x} - {L(x)}"},
        {"g_": R("avg", UP, n), "l_": R("avg", DOWN, n)},
        {out: "CASE WHEN l_ = 0 AND g_ > 0 THEN 100 ELSE 100 - 100 / (1 + g_ / nullif(l_, 0)) END"},
    ]


def chain(bars: str, stages: list[dict[str, str]]) -> tuple[list[str], str]:
    """Bars, then one table a stage, each with the columns before it and its own; and the name of the last."""
    return [f"b0 AS ({BARS[bars]})", *(more := over("b0", stages))[0]], more[1]


def over(table: str, stages: list[dict[str, str]], name: str = "b") -> tuple[list[str], str]:
    parts, last = [], table
    for k, stage in enumerate(stages, 1):
        own = ", ".join(f"{e} AS {c}" for c, e in stage.items())
        replaced = [c for c in stage if c in _known(stages[: k - 1])]
        parts.append(f"{name}{k} AS (SELECT *{f' EXCLUDE ({", ".join(replaced)})' if replaced else ''}, {own} FROM {last})")
        last = f"{name}{k}"
    return parts, last


def listed(outs: dict[str, str]) -> str:
    return ", ".join(f"CAST({c} AS INTEGER) AS {c}" if t == "int" else f"{c}" if t == "bool" else f"round(CAST({c} AS DOUBLE), {8 if t == 'r8' else 6}) + 0.0 AS {c}" for c, t in outs.items())


def sql(bars: str, outs: dict[str, str], stages: list[dict[str, str]], where: str = "") -> str:
    """The columns ``outs`` of the last stage; floats to six decimals."""
    parts, last = chain(bars, stages)
    return f"WITH {', '.join(parts)} SELECT symbol, ts, {listed(outs)} FROM {last} {where}"


def steps(bars: str, stages: list[dict[str, str]], start: dict[str, str], step: dict[str, str]) -> str:
    """Common tables that end in ``s``: a state that goes from row to row of a symbol. In ``step``, p is the state before and r the row."""
    parts, last = chain(bars, [*stages, {"n_rows": "count(*) OVER (PARTITION BY symbol)", **RN}])
    parts[-1] = parts[-1].replace(" AS (", " AS MATERIALIZED (", 1)
    begin, on = (", ".join(f"{e} AS {c}" for c, e in x.items()) for x in (start, step))
    parts.append(f"s AS (SELECT symbol, ts, rn, {begin} FROM {last} r WHERE rn = 0 UNION ALL SELECT r.symbol, r.ts, r.rn, {on} FROM s p JOIN {last} r ON r.symbol = p.symbol AND r.rn = p.rn + 1)")
    return "WITH RECURSIVE " + ", ".join(parts)


def num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def traded(bars: str, stages: list[dict[str, str]], out: str, opens: str, extra: dict[str, str], cost: float) -> str:
    """Common tables that end in ``t``, the trades of a machine with one position. ``out`` is the exit price or NULL, ``opens`` the side of a new position or 0, with p.side, p.entry and ``extra`` kept from the entry bar."""
    nothing = {"x_side": "0", "x_entry": "CAST(NULL AS DOUBLE)", "x_exit": "CAST(NULL AS DOUBLE)", "x_ts": "CAST(NULL AS TIMESTAMP)", "x_rn": "CAST(NULL AS BIGINT)"}
    first = opens.replace("p.side", "0").replace("OUT_", "CAST(NULL AS DOUBLE)")
    start = {"side": f"CAST({first} AS INTEGER)", "entry": "CAST(r.close AS DOUBLE)", "ts0": "r.ts", "rn0": "r.rn", **{k: f"CAST({v} AS DOUBLE)" for k, v in extra.items()}, **nothing}
    new = opens.replace("OUT_", f"({out})")
    step = {
        "side": f"CAST(CASE WHEN ({new}) <> 0 THEN ({new}) WHEN ({out}) IS NOT NULL THEN 0 ELSE p.side END AS INTEGER)",
        **{k: f"CASE WHEN ({new}) <> 0 THEN {v} ELSE p.{k} END" for k, v in {"entry": "r.close", "ts0": "r.ts", "rn0": "r.rn", **extra}.items()},
        "x_side": f"CASE WHEN ({out}) IS NOT NULL THEN p.side ELSE 0 END", "x_entry": "p.entry", "x_exit": f"({out})", "x_ts": "p.ts0", "x_rn": "p.rn0",
    }
    done = f"t AS (SELECT symbol, x_side AS side, x_ts AS entry_ts, ts AS exit_ts, x_entry AS entry, x_exit AS exit, CAST(rn - x_rn AS INTEGER) AS bars, x_side * (x_exit / x_entry - 1) - {num(2 * cost)} AS ret FROM s WHERE x_side <> 0)"
    return steps(bars, stages, start, step) + ", " + done


def _known(stages: list[dict[str, str]]) -> set[str]:
    return {"open", "high", "low", "close", "volume"} | {c for s in stages for c in s}
