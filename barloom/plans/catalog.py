"""The registered queries of the market-bar operators, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.windows import diff as _diff
from barloom.operators import additive, backtest, candles, extra, features, labels, learning, levels, momentum, networks, patterns, portfolio, signals, trend, volatility, volume
from barloom.plans.oracle import BARS, CUM, DOWN, HL2, RN, TP, TR, UP, D, E, EG, L, O, R, W, listed, num, over, rsi, sql, steps, traded
from barloom.sources import bars as sources

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def shown(df: DataFrame, outs: dict[str, str]) -> DataFrame:
    cast = {"int": lambda c: F.col(c).cast("int"), "bool": F.col, "num": lambda c: F.round(F.col(c).cast("double"), 6), "r8": lambda c: F.round(F.col(c).cast("double"), 8)}
    return df.select("symbol", "ts", *[cast[t](c).alias(c) for c, t in outs.items()])


def add(name: str, bars: str, fn: Callable[[DataFrame], DataFrame], outs: str, stages: list[dict[str, str]] | None, text: str | None = None) -> None:
    """Register ``fn`` over ``bars``; ``outs`` names its columns (``:int`` and ``:bool`` for flags)."""
    kinds = {c.split(":")[0]: (c.split(":") + ["num"])[1] for c in outs.split()}
    _QUERIES[name] = lambda spark, d: shown(fn(getattr(sources, bars)(spark, d)), kinds)
    if text or stages is not None:
        _ORACLE[name] = text or sql(bars, kinds, stages)


def _flagship(df: DataFrame) -> DataFrame:
    d = volatility.bbands(momentum.rsi(df), 20)
    return d.withColumn("signal", F.when((F.col("rsi") < 30) & (F.col("close") < F.col("bb_lower")), 1).when((F.col("rsi") > 70) & (F.col("close") > F.col("bb_upper")), -1).otherwise(0))


add("flagship", "hourly", _flagship, "close rsi bb_middle bb_upper bb_lower signal:int", [*rsi("close", 14, "rsi"), {"bb_middle": R("avg", "close", 20), "s": R("stddev_samp", "close", 20)}, {"bb_upper": "bb_middle + 2 * s", "bb_lower": "bb_middle - 2 * s"}, {"signal": "CASE WHEN rsi < 30 AND close < bb_lower THEN 1 WHEN rsi > 70 AND close > bb_upper THEN -1 ELSE 0 END"}])

for _b in ("hourly", "by_type", "daily_orders", "market"):
    add(f"bars_{_b}", _b, lambda df: df, "open high low close volume", [])

# ---- trend ----
add("tr1_ema", "by_type", trend.ema, "ema", [{"ema": E("close", 14)}])
add("tr2_dema", "by_type", trend.dema, "dema", [{"e1": E("close", 14)}, {"dema": f"2 * e1 - {E('e1', 14)}"}])
add("tr3_tema", "by_type", trend.tema, "tema", [{"e1": E("close", 14)}, {"e2": E("e1", 14)}, {"tema": f"3 * e1 - 3 * e2 + {E('e2', 14)}"}])
_t3 = lambda n: [{"e1": E("close", n)}, *[{f"e{k}": E(f"e{k - 1}", n)} for k in range(2, 7)]]
_mix = "-0.343 * e6 + (3 * 0.49 + 3 * 0.343) * e5 + (-6 * 0.49 - 3 * 0.7 - 3 * 0.343) * e4 + (1 + 3 * 0.7 + 0.343 + 3 * 0.49) * e3"
add("tr4_t3ribbon", "by_type", lambda d: trend.t3ribbon(d, (8, 13)), "t3_8 t3_13", [*_t3(8), {"t3_8": _mix}, *_t3(13), {"t3_13": _mix}])
add("tr5_trend_lines", "by_type", trend.trend_lines, "support resistance trend", [RN, {"support": R("min", "close", 14), "resistance": R("max", "close", 14), "trend": f"CASE WHEN rn >= 14 THEN {O('regr_slope', 'close, rn', -14, -1)} END"}])
add("tr6_macd", "by_type", trend.macd, "macd macd_signal macd_hist", [{"macd": f"{E('close', 12)} - {E('close', 26)}"}, {"macd_signal": E("macd", 9)}, {"macd_hist": "macd - macd_signal"}])
add("tr7_adx", "by_type", trend.adx, "adx plus_di minus_di", [{"tr": TR, "up": f"high - {L('high')}", "dn": f"{L('low')} - low"}, {"p": "CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END"}, {"m": "CASE WHEN dn > p AND dn > 0 THEN dn ELSE 0 END"}, {"a": E("tr", 14)}, {"plus_di": D(f"100 * {E('p', 14)}", "a"), "minus_di": D(f"100 * {E('m', 14)}", "a")}, {"dx": D("100 * abs(plus_di - minus_di)", "plus_di + minus_di")}, {"adx": EG("dx", 14)}])
_to = f"(p.psar + p.af * (p.ep - p.psar))"
_rev = f"(p.up AND r.low < {_to} OR NOT p.up AND r.high > {_to})"
_sar = steps("by_type", [{"h1": L("high"), "h2": L("high", 2), "l1": L("low"), "l2": L("low", 2)}], {"psar": "CAST(low AS DOUBLE)", "ep": "CAST(high AS DOUBLE)", "af": num(0.02), "up": "true"}, {
    "psar": f"CASE WHEN {_rev} THEN p.ep WHEN p.up THEN least({_to}, r.l1, r.l2) ELSE greatest({_to}, r.h1, r.h2) END",
    "ep": f"CASE WHEN {_rev} THEN CASE WHEN p.up THEN r.low ELSE r.high END WHEN p.up THEN greatest(p.ep, r.high) ELSE least(p.ep, r.low) END",
    "af": f"CASE WHEN {_rev} THEN {num(0.02)} WHEN p.up AND r.high > p.ep OR NOT p.up AND r.low < p.ep THEN least(p.af + {num(0.02)}, {num(0.2)}) ELSE p.af END",
    "up": f"p.up <> {_rev}",
})
add("tr8_parabolic_sar", "by_type", trend.parabolic_sar, "psar", None, f"{_sar} SELECT symbol, ts, {listed({'psar': 'num'})} FROM s")
_mid = lambda n: f"({R('max', 'high', n)} + {R('min', 'low', n)}) / 2"
add("tr9_ichimoku", "by_type", trend.ichimoku, "tenkan kijun span_a span_b chikou", [{"tenkan": _mid(9), "kijun": _mid(26), "sb": _mid(52)}, {"span_a": f"({L('tenkan', 26)} + {L('kijun', 26)}) / 2", "span_b": L("sb", 26), "chikou": L("close", -26)}])
_wma = lambda x, n: f"(({R('sum', f'rn * {x}', n)} - (rn - {n}) * {R('sum', x, n)}) / {n * (n + 1) / 2})"
add("tr10_hma", "by_type", trend.hma, "hma", [RN, {"raw": f"2 * {_wma('close', 8)} - {_wma('close', 16)}"}, {"hma": _wma("raw", 4)}])
add("tr12_donchian_channel", "by_type", trend.donchian_channel, "donchian_upper donchian_lower donchian_middle", [{"donchian_upper": R("max", "high", 20), "donchian_lower": R("min", "low", 20)}, {"donchian_middle": "(donchian_upper + donchian_lower) / 2"}])
add("tr13_keltner_channel", "by_type", trend.keltner_channel, "keltner_middle keltner_upper keltner_lower", [{"tp": TP, "tr": TR}, {"keltner_middle": E("tp", 20), "a": E("tr", 10)}, {"keltner_upper": "keltner_middle + 2 * a", "keltner_lower": "keltner_middle - 2 * a"}])
_g = {f"short_ema_{n}": n for n in (3, 5, 8, 10, 12, 15)} | {f"long_ema_{n}": n for n in (30, 35, 40, 45, 50, 60)}
add("tr14_gmma", "by_type", trend.gmma, " ".join(f"{c}:r8" for c in _g), [{c: E("close", n) for c, n in _g.items()}])

# ---- momentum ----
add("mo1_rsi", "by_type", momentum.rsi, "rsi", rsi("close", 14, "rsi"))
add("mo2_stoch_rsi", "by_type", momentum.stoch_rsi, "stoch_rsi_k stoch_rsi_d", [*rsi("close", 14, "r"), {"s": f"100 * {D('r - ' + R('min', 'r', 14), R('max', 'r', 14) + ' - ' + R('min', 'r', 14))}"}, {"stoch_rsi_k": R("avg", "s", 3)}, {"stoch_rsi_d": R("avg", "stoch_rsi_k", 3)}])
add("mo3_stoch", "by_type", momentum.stoch, "stoch_k stoch_d", [{"hh": R("max", "high", 14), "ll": R("min", "low", 14)}, {"stoch_k": f"100 * {D('close - ll', 'hh - ll')}"}, {"stoch_d": R("avg", "stoch_k", 3)}])
add("mo4_roc", "by_type", momentum.roc, "roc", [{"roc": f"100 * {D('close - ' + L('close', 10), L('close', 10))}"}])
add("mo5_ao", "by_type", momentum.ao, "ao", [{"m": HL2}, {"ao": f"{R('avg', 'm', 5)} - {R('avg', 'm', 34)}"}])
add("mo6_cci", "by_type", momentum.cci, "cci", [{"tp": TP}, {"ma": R("avg", "tp", 20), "l": O("list", "tp", -19, 0)}, {"cci": D("tp - ma", "0.015 * list_sum(list_transform(l, lambda v: abs(v - ma))) / 20")}])
add("mo7_mom", "by_type", momentum.mom, "mom", [{"mom": f"close - {L('close', 10)}"}])
add("mo8_williamsr", "by_type", momentum.williamsr, "williamsr", [{"hh": R("max", "high", 14), "ll": R("min", "low", 14)}, {"williamsr": f"-100 * {D('hh - close', 'hh - ll')}"}])
add("mo9_cmo", "by_type", momentum.cmo, "cmo", [{"d": f"close - {L('close')}"}, {"g": R("sum", UP, 14), "l": R("sum", DOWN, 14)}, {"cmo": f"100 * {D('g - l', 'g + l')}"}])
_uo = lambda n: D(R("sum", "bp", n), R("sum", "tr", n))
add("mo10_uo", "by_type", momentum.uo, "uo", [{"bp": f"close - least(low, {L('close')})", "tr": TR}, {"uo": f"100 * (4 * {_uo(7)} + 2 * {_uo(14)} + {_uo(28)}) / 7"}])
add("mo11_rsi_divergence", "by_type", momentum.rsi_divergence, "regular_bullish:int regular_bearish:int", [*rsi("close", 14, "r"), {"p": f"close - {L('close', 2)}", "q": f"r - {L('r', 2)}"}, {"regular_bullish": "CASE WHEN p < 0 AND q > 0 THEN 1 ELSE 0 END", "regular_bearish": "CASE WHEN p > 0 AND q < 0 THEN 1 ELSE 0 END"}])
add("mo12_kst", "by_type", momentum.kst, "kst kst_signal", [{f"r{n}": f"100 * {D('close - ' + L('close', n), L('close', n))}" for n in (10, 15, 20, 30)}, {"kst": f"{R('avg', 'r10', 10)} + 2 * {R('avg', 'r15', 10)} + 3 * {R('avg', 'r20', 10)} + 4 * {R('avg', 'r30', 15)}"}, {"kst_signal": R("avg", "kst", 9)}])
_st = lambda x: f"CASE WHEN rn >= 10 AND lo IS NOT NULL THEN CASE WHEN hi = lo THEN 0 ELSE 100 * ({x} - lo) / (hi - lo) END END"
add("mo13_stc", "by_type", momentum.stc, "stc", [RN, {"m": f"{E('close', 23)} - {E('close', 50)}"}, {"lo": O("min", "m", -10, -1), "hi": O("max", "m", -10, -1)}, {"k": _st("m")}, {"lo": O("min", "k", -10, -1), "hi": O("max", "k", -10, -1)}, {"d": _st("k")}, {"stc": R("avg", "d", 3)}])
add("mo14_els", "by_type", momentum.els, "impulse:int", [{"m": f"{E('close', 12)} - {E('close', 26)}", "e": E("close", 13)}, {"h": f"m - {E('m', 9)}"}, {"a": f"h - {L('h')}", "b": f"e - {L('e')}"}, {"impulse": "CASE WHEN a > 0 AND b > 0 THEN 1 WHEN a < 0 AND b < 0 THEN -1 ELSE 0 END"}])
add("mo15_squeeze_momentum", "by_type", momentum.squeeze_momentum, "squeeze_on:int squeeze_momentum", [{"tp": TP, "tr": TR}, {"ma": R("avg", "tp", 20), "s": R("stddev_pop", "tp", 20), "a": R("avg", "tr", 20), "hh": R("max", "high", 20), "ll": R("min", "low", 20)}, {"squeeze_on": "CASE WHEN ma - 2 * s > ma - 1.5 * a AND ma + 2 * s < ma + 1.5 * a THEN 1 ELSE 0 END", "squeeze_momentum": "tp - ((hh + ll) / 2 + ma) / 2"}])
add("mo16_rvi", "by_type", momentum.rvi, "rvi rvi_signal", [RN, {"v": "(close - open) / CASE WHEN high = low THEN 1 ELSE high - low END"}, {"rvi": _wma("v", 10)}, {"rvi_signal": R("avg", "rvi", 4)}])
add("mo17_dpo", "by_type", momentum.dpo, "dpo", [{"ma": R("avg", "close", 11)}, {"dpo": f"close - {L('ma', 10)}"}])
add("mo18_connors_rsi", "daily_orders", momentum.connors_rsi, "connors_rsi", [*rsi("close", 3, "a"), {"s": f"coalesce(sign(close - {L('close')}), 0)", "c": D(f"close - {L('close')}", L("close"))}, {"nw": f"CASE WHEN s = 0 OR {L('s')} IS NULL OR s <> {L('s')} THEN 1 ELSE 0 END"}, {"run": f"sum(nw) OVER ({W} ROWS UNBOUNDED PRECEDING)"}, {"streak": "s * row_number() OVER (PARTITION BY symbol, run ORDER BY ts)"}, *rsi("streak", 2, "b"), {"w": O("list", "c", -99, 0), "n": O("count", "c", -99, 0)}, {"connors_rsi": "CASE WHEN n = 100 THEN (a + b + 100.0 * len(list_filter(w, lambda v: v < c)) / 100) / 3 END"}])
add("mo19_vortex", "by_type", momentum.vortex, "vi_plus vi_minus", [{"p": f"abs(high - {L('low')})", "m": f"abs(low - {L('high')})", "tr": TR}, {"vi_plus": D(R("sum", "p", 14), R("sum", "tr", 14)), "vi_minus": D(R("sum", "m", 14), R("sum", "tr", 14))}])
add("mo20_choppiness", "by_type", momentum.choppiness, "choppiness", [{"tr": TR}, {"choppiness": f"100 * log10({D(R('sum', 'tr', 14), R('max', 'high', 14) + ' - ' + R('min', 'low', 14))}) / log10(14)"}])

# ---- volume ----
_mfv = {"f": f"coalesce({D('(close - low) - (high - close)', 'high - low')}, 0) * volume"}
add("vo1_obv", "by_type", volume.obv, "obv", [{"x": f"coalesce(sign(close - {L('close')}), 0) * volume"}, {"obv": CUM("x")}])
add("vo2_vma", "by_type", volume.vma, "vma", [{"vma": R("avg", "volume", 20)}])
add("vo3_vo", "by_type", volume.vo, "vo vo_percent", [{"vo": f"{R('avg', 'volume', 5)} - {R('avg', 'volume', 10)}"}, {"vo_percent": f"100 * {D('vo', R('avg', 'volume', 10))}"}])
add("vo4_cmf", "by_type", volume.cmf, "cmf", [_mfv, {"cmf": D(R("sum", "f", 20), R("sum", "volume", 20))}])
add("vo5_adline", "by_type", volume.adline, "adline", [_mfv, {"adline": CUM("f")}])
add("vo6_mfi", "by_type", volume.mfi, "mfi", [{"tp": TP}, {"d": f"tp - {L('tp')}"}, {"p": "CASE WHEN d > 0 THEN tp * volume ELSE 0 END", "n": "CASE WHEN d < 0 THEN tp * volume ELSE 0 END"}, {"ps": R("sum", "p", 14), "ns": R("sum", "n", 14)}, {"mfi": "100 - 100 / (1 + CASE WHEN ns = 0 THEN 100 ELSE ps / ns END)"}])
add("vo7_vwap", "by_type", volume.vwap, "vwap", [{"day": "date_trunc('day', ts)", "pv": f"{TP} * volume"}, {"vwap": "sum(pv) OVER (PARTITION BY symbol, day ORDER BY ts ROWS UNBOUNDED PRECEDING) / nullif(sum(volume) OVER (PARTITION BY symbol, day ORDER BY ts ROWS UNBOUNDED PRECEDING), 0)"}])
add("vo8_eom", "by_type", volume.eom, "eom", [{"m": f"{HL2} - ({L('high')} + {L('low')}) / 2", "box": D("volume / 10000", "high - low")}, {"e": D("m", "box")}, {"eom": R("avg", "e", 14)}])
add("vo9_pvt", "by_type", volume.pvt, "pvt", [{"x": f"({D('close', L('close'))} - 1) * volume"}, {"pvt": CUM("x")}])
add("vo10_fi", "by_type", volume.fi, "fi", [{"x": f"(close - {L('close')}) * volume"}, {"fi": E("x", 13)}])
add("vo11_kvo", "by_type", volume.kvo, "kvo kvo_signal", [{"tp": TP}, {"x": f"volume * sign(tp - {L('tp')})"}, {"kvo": f"{E('x', 34)} - {E('x', 55)}"}, {"kvo_signal": E("kvo", 13)}])
add("vo12_vfi", "by_type", volume.vfi, "vfi", [{"m": HL2, "lv": "ln(volume)", "r": "high - low"}, {"d": f"m - {L('m')}", "lr": f"coalesce(lv - {L('lv')}, 0)", "cu": f"0.2 * {R('avg', 'r', 130)}"}, {"mx": f"2.5 * {R('stddev_samp', 'lr', 130)}"}, {"x": "CASE WHEN d > cu THEN 1 WHEN d < -cu THEN -1 ELSE 0 END * CASE WHEN lr > mx THEN lv WHEN lr < -mx THEN -lv ELSE 0 END"}, {"c": CUM("x")}, {"vfi": E("c", 5)}])
add("vo13_iii", "by_type", volume.iii, "iii", [{"iii": f"coalesce({D('2 * close - high - low', '(high - low) * volume')}, 0)"}])
add("vo14_nv", "by_type", volume.nv, "nv", [{"nv": D("volume", R("avg", "volume", 14))}])
add("vo15_rvol", "by_type", volume.rvol, "rvol", [{"rvol": D("volume", R("avg", "volume", 20))}])
add("vo16_dv", "by_type", volume.dv, "dv", [{"dv": f"volume - {L('volume')}"}])
add("vo17_tsv", "by_type", volume.tsv, "tsv", [{"x": f"(close - {L('close')}) * volume"}, {"tsv": R("sum", "x", 13)}])
add("vo18_vzo", "by_type", volume.vzo, "vzo", [{"x": f"coalesce(sign(close - {L('close')}), 0) * volume"}, {"q": D(f"100 * {E('x', 14)}", E("volume", 14))}, {"vzo": E("q", 6)}])
add("vo19_tvi", "by_type", volume.tvi, "tvi", [{"x": D("volume", f"abs(close - {L('close')}) / 0.01")}, {"tvi": R("avg", "x", 14)}])
add("vo20_cdv", "by_type", volume.cdv, "delta_volume cdv", [{"delta_volume": f"sign(close - {L('close')}) * volume"}, {"cdv": CUM("delta_volume")}])

# ---- volatility ----
add("vl1_bbands", "by_type", volatility.bbands, "bb_middle bb_upper bb_lower bb_bandwidth bb_percent", [{"bb_middle": R("avg", "close", 14), "s": R("stddev_samp", "close", 14)}, {"bb_upper": "bb_middle + 2 * s", "bb_lower": "bb_middle - 2 * s"}, {"bb_bandwidth": D("bb_upper - bb_lower", "bb_middle"), "bb_percent": D("close - bb_lower", "bb_upper - bb_lower")}])
add("vl2_atr", "by_type", volatility.atr, "atr", [{"tr": TR}, {"atr": E("tr", 14)}])
add("vl3_volatility_stop", "by_type", volatility.volatility_stop, "stop_long stop_short", [{"tr": TR}, {"a": E("tr", 14)}, {"stop_long": f"{R('max', 'high', 14)} - 3 * a", "stop_short": f"{R('min', 'low', 14)} + 3 * a"}])
add("vl4_high_low_range", "by_type", volatility.high_low_range, "high_low_range", [{"r": "high - low"}, {"high_low_range": D("r", R("avg", "r", 14))}])
add("vl5_envelope", "by_type", volatility.envelope, "env_middle:r8 env_upper:r8 env_lower:r8", [{"env_middle": R("avg", "close", 20)}, {"env_upper": "env_middle * 1.025", "env_lower": "env_middle * 0.975"}])
add("vl6_ulcer_index", "by_type", volatility.ulcer_index, "ulcer_index", [{"hh": R("max", "close", 14)}, {"x": f"coalesce(pow(100 * {D('close - hh', 'hh')}, 2), 0)"}, {"ulcer_index": f"sqrt({R('avg', 'x', 14)})"}])
add("vl7_natr", "by_type", volatility.normalized_atr, "natr", [{"tr": TR}, {"a": E("tr", 14)}, {"natr": f"100 * {D('a', 'close')}"}])
add("vl8_relative_volatility_index", "by_type", volatility.relative_volatility_index, "rvi_volatility", [{"s": R("stddev_samp", "close", 10), "d": f"close - {L('close')}"}, {"u": "CASE WHEN d > 0 THEN s ELSE 0 END", "f": "CASE WHEN d < 0 THEN s ELSE 0 END"}, {"a": EG("u", 14), "b": EG("f", 14)}, {"rvi_volatility": D("100 * a", "a + b")}])
add("vl9_cboe_vix", "by_type", volatility.cboe_vix, "vix_short vix_long vix_ratio", [{"r": f"ln({D('close', L('close'))})"}, {"vix_short": f"100 * sqrt(252) * {R('stddev_samp', 'r', 9)}", "vix_long": f"100 * sqrt(252) * {R('stddev_samp', 'r', 30)}"}, {"vix_ratio": D("vix_short", "vix_long")}])
add("vl10_z_score", "by_type", volatility.z_score, "z_score", [{"z_score": D(f"close - {R('avg', 'close', 20)}", R("stddev_samp", "close", 20))}])
add("vl11_true_range_percent", "by_type", volatility.true_range_percent, "true_range_percent", [{"true_range_percent": f"100 * {D(TR, L('close'))}"}])
add("vl12_volatility_ratio", "by_type", volatility.volatility_ratio, "volatility_ratio", [{"p": f"{D('close', L('close'))} - 1"}, {"volatility_ratio": D(R("stddev_samp", "p", 5), R("stddev_samp", "p", 20))}])
_full = f"{O('count', 'high', -5, -1)} = 5 AND {O('count', 'high', 1, 5)} = 5"
add("vl13_fractal_chaos_bands", "by_type", volatility.fractal_chaos_bands, "fcb_upper fcb_lower", [{"t": f"CASE WHEN {_full} AND high > {O('max', 'high', -5, -1)} AND high >= {O('max', 'high', 1, 5)} THEN high END", "b": f"CASE WHEN {_full} AND low < {O('min', 'low', -5, -1)} AND low <= {O('min', 'low', 1, 5)} THEN low END"}, {"fcb_upper": f"last_value(t IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING)", "fcb_lower": f"last_value(b IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING)"}])
add("vl14_directional_volatility", "by_type", volatility.directional_volatility, "atr_roc atr_roc_ema directional_vol:int vol_strength", [{"tr": TR}, {"a": E("tr", 14)}, {"atr_roc": f"100 * {D('a - ' + L('a', 14), L('a', 14))}"}, {"atr_roc_ema": E("atr_roc", 14)}, {"directional_vol": "CASE WHEN atr_roc_ema > 0 THEN 1 ELSE -1 END", "vol_strength": "abs(atr_roc_ema)"}])


# ---- extra ----
_top = "CASE WHEN r.rn < 10 THEN 0 WHEN r.c1 <= p.top OR r.u < r.u1 THEN least(r.u, p.top) ELSE r.u END"
_bottom = "CASE WHEN r.rn < 10 THEN 0 WHEN r.c1 >= p.bottom OR r.w > r.w1 THEN greatest(r.w, p.bottom) ELSE r.w END"
_zero = num(0.0)
_super = steps("by_type", [{"tr": TR, "c1": L("close")}, {"a": R("avg", "tr", 10)}, {"u": f"{HL2} + 3 * a", "w": f"{HL2} - 3 * a"}, {"u1": L("u"), "w1": L("w")}], {"top": _zero, "bottom": _zero, "supertrend": _zero, "supertrend_direction": "0"}, {
    "top": _top, "bottom": _bottom,
    "supertrend": f"CASE WHEN r.rn < 10 THEN 0 WHEN r.close <= {_top} THEN {_top} ELSE {_bottom} END", "supertrend_direction": f"CASE WHEN r.rn < 10 THEN 0 WHEN r.close <= {_top} THEN -1 ELSE 1 END",
})
add("ex1_supertrend", "by_type", extra.supertrend, "supertrend supertrend_direction", None, f"{_super} SELECT symbol, ts, {listed({'supertrend': 'num', 'supertrend_direction': 'num'})} FROM s")
add("ex2_vervoort_tsi", "by_type", extra.vervoort_tsi, "tsi tsi_signal tsi_hist", [{"d": f"close - {L('close')}"}, {"ad": "abs(d)"}, {"e1": E("d", 25), "f1": E("ad", 25)}, {"tsi": D(f"100 * {E('e1', 13)}", E("f1", 13))}, {"tsi_signal": E("tsi", 7)}, {"tsi_hist": "tsi - tsi_signal"}])
_wide = lambda a, b, k: f"({O('max', 'close', a, b)} - {O('min', 'close', a, b)}) / {k}"
_mean_of = lambda first, at, w: {"y": f"CASE WHEN r.rn = {at} THEN {first} WHEN r.rn > {at} THEN {w} * r.close + (1 - {w}) * p.y END"}
_no = {"y": "CAST(NULL AS DOUBLE)"}
_frama = steps("by_type", [{"n1": _wide(-16, -9, 8), "n2": _wide(-8, -1, 8), "n3": _wide(-16, -1, 16), "m": O("avg", "close", -15, 0)}, {"dim": f"CASE WHEN n1 + n2 > 0 THEN CASE WHEN n3 > 0 THEN log2((n1 + n2) / n3) ELSE 2 END ELSE 1 END"}, {"w": f"2 / (exp({num(-4.6)} * (least(greatest(dim, 1), 2) - 1)) * -199 + 201)"}], _no, _mean_of("r.m", 15, "r.w"))
add("ex3_frama", "by_type", extra.frama, "frama", None, f"{_frama} SELECT symbol, ts, round(y, 6) + 0.0 AS frama FROM s")
_reg = lambda f: f"CASE WHEN {O('count', 'close', -19, 0)} = 20 THEN {O(f, 'close, rn', -19, 0)} END"
add("ex4_regression_channel", "by_type", extra.regression_channel, "reg_slope reg_intercept reg_r2 reg_line reg_upper reg_lower", [RN, {"reg_slope": _reg("regr_slope"), "i": _reg("regr_intercept"), "reg_r2": _reg("regr_r2"), "syy": _reg("regr_syy"), "sxy": _reg("regr_sxy")}, {"reg_intercept": "i + reg_slope * (rn - 19)", "reg_line": "i + reg_slope * rn", "e": "2 * sqrt(greatest(syy - reg_slope * sxy, 0) / 18)"}, {"reg_upper": "reg_line + e", "reg_lower": "reg_line - e"}])
_vidya = steps("by_type", [{"d": f"close - {L('close')}"}, {"g": R("sum", "CASE WHEN d >= 0 THEN d ELSE 0 END", 9), "l": R("sum", "CASE WHEN d < 0 THEN -d ELSE 0 END", 9)}, {"w": f"{num(2 / 27)} * coalesce(abs({D('g - l', 'g + l')}), 0)"}], _no, _mean_of("r.close", 9, "r.w"))
add("ex5_vidya", "by_type", extra.vidya, "vidya", None, f"{_vidya} SELECT symbol, ts, round(y, 6) + 0.0 AS vidya FROM s")
add("ex6_instantaneous_trendline", "by_type", extra.instantaneous_trendline, "it", [{"it": f"list_reduce(list(close) OVER ({W} ROWS UNBOUNDED PRECEDING), lambda p, q: CASE WHEN q > p THEN 0.07::DOUBLE * q + 0.93::DOUBLE * p ELSE 0.14::DOUBLE * q + 0.86::DOUBLE * p END)"}])
add("ex7_zlsma", "by_type", extra.zlsma, "zlsma", [{"x": f"2 * close - {L('close', 24)}"}, {"zlsma": E("x", 50)}])
_mcg = steps("by_type", [{"m": O("avg", "close", -13, 0)}], _no, {"y": f"CASE WHEN r.rn = 13 THEN r.m WHEN r.rn > 13 THEN p.y + (r.close - p.y) / ({num(0.6 * 14)} * pow(r.close / p.y, 4)) END"})
add("ex8_mcginley_dynamic", "by_type", extra.mcginley_dynamic, "mcginley", None, f"{_mcg} SELECT symbol, ts, CASE WHEN isfinite(y) THEN round(y, 6) + 0.0 END AS mcginley FROM s")
add("ex9_ib_boxes", "by_type", extra.ib_boxes, "inside_bar:int ib_high ib_low ib_breakout:int ib_high_line ib_low_line", [{"inside_bar": f"CASE WHEN high <= {L('high')} AND low >= {L('low')} THEN 1 ELSE 0 END"}, {"ib_high": f"CASE WHEN inside_bar = 1 THEN {L('high')} END", "ib_low": f"CASE WHEN inside_bar = 1 THEN {L('low')} END"}, {"ib_breakout": f"CASE WHEN close > {L('ib_high')} THEN 1 WHEN close < {L('ib_low')} THEN -1 ELSE 0 END"}, {"g": f"sum(CASE WHEN ib_breakout <> 0 AND inside_bar = 0 THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING)"}, {"ib_high_line": "first_value(ib_high IGNORE NULLS) OVER (PARTITION BY symbol, g ORDER BY ts ROWS UNBOUNDED PRECEDING)", "ib_low_line": "first_value(ib_low IGNORE NULLS) OVER (PARTITION BY symbol, g ORDER BY ts ROWS UNBOUNDED PRECEDING)"}])

# ---- levels ----
_hlc = {"h": L("high"), "lo": L("low"), "c": L("close")}
_methods = {
    "standard": {"r1": "2 * pivot_point - lo", "s1": "2 * pivot_point - h", "r2": "pivot_point + h - lo", "s2": "pivot_point - (h - lo)", "r3": "2 * pivot_point - lo + h - lo", "s3": "2 * pivot_point - h - (h - lo)"},
    "fibonacci": {"r1": "pivot_point + 0.382 * (h - lo)", "s1": "pivot_point - 0.382 * (h - lo)", "r2": "pivot_point + 0.618 * (h - lo)", "s2": "pivot_point - 0.618 * (h - lo)", "r3": "pivot_point + (h - lo)", "s3": "pivot_point - (h - lo)"},
    "camarilla": {"r1": "c + 1.1 * (h - lo) / 12", "s1": "c - 1.1 * (h - lo) / 12", "r2": "c + 1.1 * (h - lo) / 6", "s2": "c - 1.1 * (h - lo) / 6", "r3": "c + 1.1 * (h - lo) / 4", "s3": "c - 1.1 * (h - lo) / 4"},
    "woodie": {"r1": "2 * pivot_point - lo", "s1": "2 * pivot_point - h", "r2": "pivot_point + h - lo", "s2": "pivot_point - (h - lo)"},
}
for _m, _e in _methods.items():
    add(f"sr1_pivot_points_{_m}", "by_type", lambda d, m=_m: levels.pivot_points(d, m), " ".join(f"{c}:r8" for c in ("pivot_point", *_e)), [_hlc, {"pivot_point": "(h + lo + 2 * c) / 4" if _m == "woodie" else "(h + lo + c) / 3"}, _e])
_all5 = f"{O('count', 'high', -5, -1)} = 5 AND {O('count', 'high', 1, 5)} = 5"
add("sr2_swings", "by_type", levels.swings, "swing_high:int swing_low:int", [{"swing_high": f"CASE WHEN {_all5} AND high > greatest({O('max', 'high', -5, -1)}, {O('max', 'high', 1, 5)}) THEN 1 ELSE 0 END", "swing_low": f"CASE WHEN {_all5} AND low < least({O('min', 'low', -5, -1)}, {O('min', 'low', 1, 5)}) THEN 1 ELSE 0 END"}])


def _blocks() -> str:
    """Each strong move marks the last opposite candle of the ten before it."""
    from barloom.plans.oracle import BARS

    side = lambda name, move, candle: f"m{name} AS (SELECT DISTINCT symbol, j FROM (SELECT a.symbol, max(b.rn) AS j FROM r a JOIN r b ON a.symbol = b.symbol AND b.rn BETWEEN greatest(1, a.rn - 10) AND a.rn - 1 AND {candle} WHERE a.rn >= 10 AND {move} GROUP BY a.symbol, a.rn))"
    return f"""WITH b0 AS ({BARS['by_type']}), r AS (SELECT *, row_number() OVER ({W}) - 1 AS rn, close / nullif({L('close')}, 0) - 1 AS m FROM b0),
        {side('u', 'a.m > 0.01', 'b.close < b.open')}, {side('d', 'a.m < -0.01', 'b.close > b.open')}
        SELECT r.symbol, r.ts, CASE WHEN mu.j IS NOT NULL THEN high END AS bullish_ob_top, CASE WHEN mu.j IS NOT NULL THEN low END AS bullish_ob_bottom,
        CASE WHEN md.j IS NOT NULL THEN high END AS bearish_ob_top, CASE WHEN md.j IS NOT NULL THEN low END AS bearish_ob_bottom
        FROM r LEFT JOIN mu ON mu.symbol = r.symbol AND mu.j = r.rn LEFT JOIN md ON md.symbol = r.symbol AND md.j = r.rn"""


add("sr3_order_blocks", "by_type", levels.order_blocks, "bullish_ob_top bullish_ob_bottom bearish_ob_top bearish_ob_bottom", None, _blocks())
_far = "abs(CASE WHEN p.anchor <> 0 THEN (r.close / p.anchor - 1) * 100 ELSE 0 END) > 5"
_zig = steps("by_type", [], {"anchor": "CAST(close AS DOUBLE)", "zigzag": "CAST(close AS DOUBLE)"}, {"anchor": f"CASE WHEN {_far} THEN r.close ELSE p.anchor END", "zigzag": f"CASE WHEN {_far} THEN r.close END"})
add("sr4_zigzag", "by_type", levels.zigzag, "zigzag", None, f"{_zig} SELECT symbol, ts, {listed({'zigzag': 'num'})} FROM s")
add("sr5_mean_reversion_channel", "by_type", levels.mean_reversion_channel, "ma std upper_band lower_band support_zone resistance_zone", [{"ma": R("avg", "close", 20), "std": R("stddev_samp", "close", 20)}, {"upper_band": "ma + 2 * std", "lower_band": "ma - 2 * std"}, {"support_zone": f"CASE WHEN close < lower_band AND {L('close')} >= {L('lower_band')} THEN lower_band END", "resistance_zone": f"CASE WHEN close > upper_band AND {L('close')} <= {L('upper_band')} THEN upper_band END"}])

# ---- candles: o1 is the open one bar back, and so on ----
_back = {f"{c}{k}": L(n, k) for c, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close")) for k in (1, 2, 3)}
_now = {"o": "open", "h": "high", "l": "low", "c": "close"}
_inv = "h - greatest(o, c) >= 2 * abs(c - o) AND least(o, c) - l <= 0.25 * (h - l) AND abs(c - o) > 0"
_ham = "least(o, c) - l >= 2 * abs(c - o) AND h - greatest(o, c) <= 0.25 * (h - l) AND abs(c - o) > 0"
_rules = {
    "doji": "abs(c - o) <= 0.1 * (h - l)", "inverted_hammer": _inv, "hammer": _ham, "shooting_star": f"{_inv} AND c1 > o1", "hanging_man": f"{_ham} AND c1 > o1",
    "bullish_engulfing": "c1 < o1 AND c > o AND o <= c1 AND c >= o1", "bearish_engulfing": "c1 > o1 AND c < o AND o >= c1 AND c <= o1",
    "morning_star": "c2 < o2 AND abs(c1 - o1) < 0.3 * (o2 - c2) AND c > o AND c > o2", "piercing_pattern": "c1 < o1 AND o < c1 AND c > (o1 + c1) / 2 AND c < o1",
    "dark_cloud_cover": "c1 > o1 AND o > c1 AND c < (o1 + c1) / 2 AND c > o1", "evening_star": "c2 > o2 AND abs(c1 - o1) < 0.3 * (c2 - o2) AND c < o AND c < o2",
    "three_white_soldiers": "c2 > o2 AND c1 > o1 AND o1 > o2 AND c1 > c2 AND c > o AND o > o1 AND c > c1", "three_black_crows": "c2 < o2 AND c1 < o1 AND o1 < o2 AND c1 < c2 AND c < o AND o < o1 AND c < c1",
    "rickshaw_man": "abs(c - o) < 0.1 * (h - l) AND h - greatest(o, c) > 0.4 * (h - l) AND least(o, c) - l > 0.4 * (h - l)",
    "high_wave": "abs(c - o) < h - greatest(o, c) AND abs(c - o) < least(o, c) - l AND h - greatest(o, c) > 0.03 AND least(o, c) - l > 0.03",
    "matching_low": "c = c1 AND c < o AND c1 < o1", "matching_high": "c = c1 AND c > o AND c1 > o1", "tasuki_gap": "o2 > c2 AND o1 > c1 AND o < c",
    "advance_block": "c2 > o2 AND c1 > o1 AND c1 > c2 AND c > o AND c > c1 AND h - c > c - o", "deliberation": "c > c1 AND c1 > c2 AND c - o < c1 - o1",
    "tristar": "abs(c2 - o2) < 0.1 AND abs(c1 - o1) < 0.1 AND abs(c - o) < 0.1", "kicker": "c1 < o1 AND o > c1 AND c > o", "separating_lines": "c1 > o1 AND o = o1 AND c > o",
    "stick_sandwich": "c2 < o2 AND c1 > o1 AND c < o AND c = c2", "three_inside_up": "c2 < o2 AND c1 > o1 AND c1 > o2 AND c > c1", "three_inside_down": "c2 > o2 AND c1 < o1 AND c1 < o2 AND c < c1",
    "tower_top": "c2 > o2 AND abs(c1 - o1) < 0.1 AND c < o", "ladder_bottom": "c3 < o3 AND c2 < o2 AND c1 > o1 AND c > c1", "upside_gap_two_crows": "c2 > o2 AND o1 > h2 AND c1 < o1 AND o > c1 AND c < o",
}
for _n, _r in _rules.items():
    add(f"ca_{_n}", "by_type", lambda d, n=_n: candles.pattern(d, n), f"cdl_{_n}:int", [_back, _now, {f"cdl_{_n}": f"CASE WHEN {_r} THEN {candles.PATTERNS[_n][0]} ELSE 0 END"}])
add("ca1_heikin_ashi", "by_type", candles.heikin_ashi, "open high low close", [{"c": "(open + high + low + close) / 4"}, {"x": f"coalesce({L('c')}, (open + close) / 2)"}, {"o": E("x", 3)}, {"h": "rint_(greatest(high, o, c))", "l": "rint_(least(low, o, c))"}, {"open": "rint_(o)", "close": "rint_(c)", "high": "h", "low": "l"}])
_ORACLE["ca1_heikin_ashi"] = _ORACLE["ca1_heikin_ashi"].replace("rint_(greatest(high, o, c))", "round_even(greatest(high, o, c) * 100, 0) / 100").replace("rint_(least(low, o, c))", "round_even(least(low, o, c) * 100, 0) / 100").replace("rint_(o)", "round_even(o * 100, 0) / 100").replace("rint_(c)", "round_even(c * 100, 0) / 100")
add("ca2_marubozu", "by_type", candles.marubozu, "cdl_marubozu:int", [{"cdl_marubozu": "CASE WHEN abs(open - low) < 0.001 AND abs(close - high) < 0.001 THEN 1 WHEN abs(open - high) < 0.001 AND abs(close - low) < 0.001 THEN -1 ELSE 0 END"}])
add("ca14_spinning_top", "by_type", candles.spinning_top, "cdl_spinning_top:bool", [{"b": "CASE WHEN close = open THEN 1e-6::DOUBLE ELSE abs(close - open) END", "e": "least(open, close)"}, {"cdl_spinning_top": f"coalesce({D('b', 'high - low')} < 0.3 AND (high - e) / b > 2 AND (e - low) / b > 2, false)"}])
add("ca28_harris_signal", "by_type", candles.harris_signal, "harris_signal:int", [_back, {"harris_signal": "CASE WHEN high > h1 AND h1 > low AND low > h2 AND h2 > l1 AND l1 > h3 AND h3 > l2 AND l2 > l3 THEN 1 WHEN high < h1 AND h1 < low AND low < h2 AND h2 < l1 AND l1 < h3 AND h3 < l2 AND l2 < l3 THEN -1 ELSE 0 END"}])

# ---- chart patterns ----


def _extrema(k: int, peak: bool, reach: int, rule: str, out: str) -> str:
    from barloom.plans.oracle import BARS

    f, sign = ("max", ">") if peak else ("min", "<")
    point = f"close {sign} {O(f, 'close', -k, -1)} AND close {sign} {O(f, 'close', 1, k)}"
    return f"""WITH b0 AS ({BARS['by_type']}), p AS (SELECT symbol, ts, close AS m, {point} AS hit FROM b0),
        q AS (SELECT *, lag(m, {reach}) OVER ({W}) AS a, lead(m, {reach}) OVER ({W}) AS b FROM p WHERE hit)
        SELECT b0.symbol, b0.ts, CASE WHEN {rule} THEN 1 ELSE 0 END AS {out} FROM b0 LEFT JOIN q ON q.symbol = b0.symbol AND q.ts = b0.ts"""


_top, _low = "abs(a - b) / m < 0.01 AND m > a AND m > b", "abs(a - b) / m < 0.01 AND m < a AND m < b"
_three = "a IS NOT NULL AND b IS NOT NULL AND greatest(a, m, b) - least(a, m, b) < 0.01 * m"
for _i, (_n, _k, _p, _w, _r) in enumerate((("m_top", 5, True, 1, _top), ("w_bottom", 5, False, 1, _low), ("head_and_shoulders", 5, True, 2, _top), ("inverse_head_and_shoulders", 5, False, 2, _low), ("triple_top", 5, True, 1, _three), ("triple_bottom", 5, False, 1, _three), ("cup_handle", 10, False, 1, "a > m AND m < b AND abs(a - b) / m < 0.1")), 1):
    add(f"pa{_i}_{_n}", "by_type", getattr(patterns, _n), f"{_n}:int", None, _extrema(_k, _p, _w, _r, _n))
_quad = " + ".join(f"{i * i - 440 / 12!r} * {L('close', -i) if i else 'close'}" for i in range(-10, 11))
add("pa8_rounding_bottom", "by_type", patterns.rounding_bottom, "rounding_bottom:int", [{"rounding_bottom": f"CASE WHEN ({_quad}) / {sum((i * i - 440 / 12) ** 2 for i in range(-10, 11))!r} > 0.5 THEN 1 ELSE 0 END"}])
add("pa9_rectangle", "by_type", patterns.rectangle, "rectangle:int", [{"rectangle": f"CASE WHEN {O('count', 'close', -10, -1)} = 10 AND {O('max', 'close', -10, -1)} - {O('min', 'close', -10, -1)} < 0.01 * {O('avg', 'close', -10, -1)} THEN 1 ELSE 0 END"}])
for _i, _n, _f, _s in ((10, "ascending_triangle", "max", ">"), (11, "descending_triangle", "min", "<")):
    add(f"pa{_i}_{_n}", "by_type", getattr(patterns, _n), f"{_n}:int", [RN, {_n: f"CASE WHEN rn >= 10 AND {O('regr_slope', 'close, rn', -10, -1)} {_s} 0 AND abs({O(_f, 'close', -10, -1)} - {L('close')}) < 0.01 * {O(_f, 'close', -10, -1)} THEN 1 ELSE 0 END"}])
add("pa12_symmetric_triangle", "by_type", patterns.symmetric_triangle, "symmetric_triangle:int", [{**RN, "hh": O("max", "close", -2, 0), "ll": O("min", "close", -2, 0)}, {"u": O("regr_slope", "hh, rn", -8, -1), "v": O("regr_slope", "ll, rn", -8, -1)}, {"symmetric_triangle": "CASE WHEN rn >= 10 AND u < 0 AND v > 0 AND abs(u - v) < 0.05 THEN 1 ELSE 0 END"}])

# ---- labels, regime, portfolio, signals, backtests ----
add("lb1_three_way", "by_type", labels.three_way, "label:int", [{"m": f"{D(L('close', -5), 'close')} - 1"}, {"label": "CASE WHEN m > 0.002 THEN 2 WHEN m < -0.002 THEN 1 ELSE 0 END"}])
add("lb2_next_up", "by_type", labels.next_up, "future_return target:int", [{"future_return": f"{D(L('close', -1), 'close')} - 1"}, {"target": "CASE WHEN future_return > 0 THEN 1 ELSE 0 END"}])
add("lb3_next_sign", "by_type", labels.next_sign, "target", [{"p": f"sign({D('close', L('close'))} - 1)"}, {"target": L("p", -1)}])
add("ml1_standardised", "by_type", lambda d: labels.standardised(labels.split_by_time(d), ["close", "volume"]), "close volume is_train:bool", [{**RN, "n": "count(*) OVER (PARTITION BY symbol)"}, {"is_train": "rn < floor(n * 0.8)"}, {f"{x}_{f}": f"{g}(CASE WHEN is_train THEN {x} END) OVER (PARTITION BY symbol)" for x in ("close", "volume") for f, g in (("m", "avg"), ("s", "stddev_pop"))}, {x: f"coalesce({D(f'{x} - {x}_m', f'{x}_s')}, 0)" for x in ("close", "volume")}])
add("rg3_distribution_days", "by_type", portfolio.distribution_days, "close volume distribution_day:bool", [{"distribution_day": f"coalesce(close < {L('close')} AND volume > {L('volume')} AND 100 * ({L('close')} - close) / nullif({L('close')}, 0) > 0.2, false)"}])
add("pf1_returns", "by_type", portfolio.returns, "ret", None, sql("by_type", {"ret": "num"}, [{"ret": f"{D('close', L('close'))} - 1"}], "WHERE ret IS NOT NULL"))
# Averaged bars in place of the plain ones, and the indicators over them.
_even = lambda x: f"round_even({x} * 100, 0) / 100"
_HA = [{"hc": "(open + high + low + close) / 4"}, {"hx": f"coalesce({L('hc')}, (open + close) / 2)"}, {"ho": E("hx", 3)}, {"hh": "greatest(high, ho, hc)", "hl": "least(low, ho, hc)"}, {"open": _even("ho"), "close": _even("hc"), "high": _even("hh"), "low": _even("hl")}]
_MACD = [{"macd": f"{E('close', 12)} - {E('close', 26)}"}, {"macd_signal": E("macd", 9)}]
_UO = [{"bp": f"close - least(low, {L('close')})", "tr": TR}, {"uo": f"100 * (4 * {_uo(7)} + 2 * {_uo(14)} + {_uo(28)}) / 7"}]
_TSV = [{"x": f"(close - {L('close')}) * volume"}, {"tsv": R("sum", "x", 13)}]
_MFI10 = [{"tp": TP}, {"d": f"tp - {L('tp')}"}, {"p": "CASE WHEN d > 0 THEN tp * volume ELSE 0 END", "n": "CASE WHEN d < 0 THEN tp * volume ELSE 0 END"}, {"ps": R("sum", "p", 10), "ns": R("sum", "n", 10)}, {"mfi": "100 - 100 / (1 + CASE WHEN ns = 0 THEN 100 ELSE ps / ns END)"}]
_T3 = [*_t3(8), {"t3_8": _mix}, *_t3(13), {"t3_13": _mix}]
_HARRIS = [_back, {"harris_signal": "CASE WHEN high > h1 AND h1 > low AND low > h2 AND h2 > l1 AND l1 > h3 AND h3 > l2 AND l2 > l3 THEN 1 WHEN high < h1 AND h1 < low AND low < h2 AND h2 < l1 AND l1 < h3 AND h3 < l2 AND l2 < l3 THEN -1 ELSE 0 END"}]
_CCI = [{"tp": TP}, {"ma": R("avg", "tp", 20), "l": O("list", "tp", -19, 0)}, {"cci": D("tp - ma", "0.015 * list_sum(list_transform(l, lambda v: abs(v - ma))) / 20")}]
_SG1 = [*_HA, *_MACD, *_UO, *_TSV, {"signal": "CASE WHEN macd > macd_signal AND uo > 70 AND tsv > 0 THEN 1 WHEN macd < macd_signal AND uo < 30 AND tsv < 0 THEN -1 ELSE 0 END"}]
_SG2 = [*_HA, *_T3, *_HARRIS, {"a8": L("t3_8"), "a13": L("t3_13")}, {"signal": "CASE WHEN harris_signal = 1 AND (t3_8 >= a8 OR t3_13 >= a13) THEN 1 WHEN harris_signal = -1 AND (t3_8 <= a8 OR t3_13 <= a13) THEN -1 ELSE 0 END"}]
_turn = {"m1": L("mfi"), "m2": L("mfi", 2), "c1": L("close"), "c2": L("close", 2)}
_SG3 = [*_HA, *_MFI10, _turn, {"signal": "CASE WHEN mfi <= 40 AND mfi > m1 AND m1 > m2 AND close < c1 AND c1 < c2 THEN 1 WHEN mfi >= 60 AND mfi < m1 AND m1 < m2 AND close > c1 AND c1 > c2 THEN -1 ELSE 0 END"}]
for _n, _f, _s in (("sg1_macd_uo_tsv", signals.macd_uo_tsv, _SG1), ("sg2_harris_t3", signals.harris_t3, _SG2), ("sg3_mfi_turn", signals.mfi_turn, _SG3)):
    add(_n, "by_type", _f, "signal:int", _s)
_sure = [*rsi("close", 14, "rsi"), {"e50": E("close", 50), "prediction": "CASE WHEN rsi > 50 THEN 1 ELSE 0 END", "confidence": "greatest(rsi, 100 - rsi) / 100"}, {"signal": "CASE WHEN confidence > 0.6 AND prediction = 1 AND close > e50 THEN 1 WHEN confidence > 0.6 AND prediction = 0 AND close < e50 THEN -1 ELSE 0 END"}]


def _confirmed(df: DataFrame) -> DataFrame:
    r = momentum.rsi(df)
    return signals.confirmed(df, r.select("symbol", "ts", F.coalesce((F.col("rsi") > 50).cast("int"), F.lit(0)).alias("prediction"), (F.greatest(F.col("rsi"), 100 - F.col("rsi")) / 100).alias("confidence")))


add("sg5_confirmed", "by_type", _confirmed, "signal:int", _sure)
add("rel2_traded", "by_type", sources.traded, "close volume", None, sql("by_type", {"close": "num", "volume": "num"}, [], "WHERE volume <> 0"))
_factors = {c: k for c, k in zip("canslim", (1, 2, 3, 5, 8, 13, 21))}
add("rg4_canslim", "by_type", lambda d: portfolio.canslim(d.withColumns({c: F.coalesce(F.signum(_diff("close", k)), F.lit(0.0)) for c, k in _factors.items()}), tuple(_factors)).withColumn("canslim_words", F.col("canslim")), "canslim_score canslim_words:bool", [{f"x{k}": f"coalesce(sign(close - {L('close', k)}), 0)" for k in _factors.values()}, {"canslim_score": "(" + " + ".join(f"x{k}" for k in _factors.values()) + ") / 7.0"}, {"canslim_words": "CASE WHEN canslim_score >= 0.7 THEN 'Strong Bullish' WHEN canslim_score >= 0.3 THEN 'Bullish' WHEN canslim_score <= -0.7 THEN 'Strong Bearish' WHEN canslim_score <= -0.3 THEN 'Bearish' ELSE 'Neutral' END"}])


def _plain(name: str, fn: Callable[[SparkSession, str], DataFrame], text: str | None = None) -> None:
    _QUERIES[name] = fn
    if text:
        _ORACLE[name] = text


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _traded(spark: SparkSession, d: str) -> DataFrame:
    return backtest.trades(signals.mfi_turn(sources.hourly(spark, d)), take=0.02, stop=0.02)


_b3, _b4 = f"({BARS['daily_orders']})", f"({BARS['market']})"
_plain(
    "rg1_hurst",
    lambda s, d: _rounded(portfolio.hurst(sources.daily_orders(s, d))),
    f"""WITH r AS (SELECT symbol, close, row_number() OVER ({W}) AS rn FROM {_b3}),
    s AS (SELECT a.symbol, b.rn - a.rn AS lag, stddev_pop(b.close - a.close) AS s FROM r a JOIN r b ON a.symbol = b.symbol AND b.rn - a.rn BETWEEN 2 AND 99 GROUP BY 1, 2),
    h AS (SELECT symbol, regr_slope(ln(s), ln(lag)) AS hurst FROM s WHERE s > 0 GROUP BY 1)
    SELECT symbol, round(hurst, 6) AS hurst, CASE WHEN hurst < 0.5 THEN 'mean reverting' WHEN hurst > 0.5 THEN 'trending' ELSE 'random' END AS regime FROM h""",
)
_plain(
    "pf3_inverse_volatility",
    lambda s, d: _rounded(portfolio.inverse_volatility(sources.daily_orders(s, d), sources.market(s, d))),
    f"""WITH j AS (SELECT a.symbol, a.ts, a.close, b.close AS mc FROM {_b3} a JOIN {_b4} b USING (ts)),
    r AS (SELECT symbol, close / {L('close')} - 1 AS r, mc / {L('mc')} - 1 AS m FROM j),
    t AS (SELECT symbol, stddev_samp(r) AS v, covar_samp(r, m) / var_samp(m) AS beta FROM r WHERE r IS NOT NULL AND m IS NOT NULL GROUP BY 1)
    SELECT symbol, round(v, 6) AS volatility, round(beta, 6) AS beta, round((1 / v) / sum(1 / v) OVER (), 6) AS weight FROM t""",
)
_last = "r.rn = r.n_rows - 1"
_plan = lambda take, stop, opposite: f"CASE WHEN p.side = 0 THEN NULL WHEN p.side > 0 AND r.low <= p.entry * (1 - {num(stop)}) OR p.side < 0 AND r.high >= p.entry * (1 + {num(stop)}) THEN p.entry * (1 - p.side * {num(stop)}) WHEN p.side > 0 AND r.high >= p.entry * (1 + {num(take)}) OR p.side < 0 AND r.low <= p.entry * (1 - {num(take)}) THEN p.entry * (1 + p.side * {num(take)}) WHEN {'r.signal = -p.side OR ' if opposite else ''}{_last} THEN r.close END"
_opens = f"CASE WHEN (p.side = 0 OR OUT_ IS NOT NULL) AND NOT ({_last}) THEN r.signal ELSE 0 END"
_TURNS = traded("hourly", _SG3, _plan(0.02, 0.02, True), _opens, {}, 0.0007)
_TRADE = "symbol, side, entry_ts, exit_ts, round(entry, 6) AS entry, round(exit, 6) AS exit, bars, round(ret, 6) AS ret"
_plain("bt_trades", lambda s, d: _rounded(_traded(s, d)), f"{_TURNS} SELECT {_TRADE} FROM t")
_plain(
    "bt_metrics",
    lambda s, d: _rounded(backtest.metrics(backtest.equity(_traded(s, d)))),
    f"""{_TURNS}, e AS (SELECT *, 100000 * exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY exit_ts, entry_ts ROWS UNBOUNDED PRECEDING)) AS equity FROM t),
    f AS (SELECT *, equity / greatest(max(equity) OVER (PARTITION BY symbol ORDER BY exit_ts, entry_ts ROWS UNBOUNDED PRECEDING), 100000) - 1 AS drawdown FROM e)
    SELECT symbol, round(arg_max(equity, exit_ts) / 100000 - 1, 6) AS total_return, count(*) AS n_trades, round(count(*) FILTER (ret > 0) / count(*), 6) AS win_rate, round(avg(ret) FILTER (ret > 0), 6) AS avg_win,
    round(avg(ret) FILTER (ret <= 0), 6) AS avg_loss, round(sum(ret) FILTER (ret > 0) / nullif(abs(sum(ret) FILTER (ret <= 0)), 0), 6) AS profit_factor, round(min(drawdown), 6) AS max_drawdown, round(avg(bars), 6) AS avg_bars FROM f GROUP BY symbol""",
)
_ranges = [*_MFI10, *_MACD, {"tr": TR}, {"atr": R("avg", "tr", 14), **_turn}, {"signal": "CASE WHEN mfi <= 40 AND mfi >= m1 AND m1 >= m2 AND close <= c1 AND c1 <= c2 THEN 1 WHEN mfi >= 60 AND mfi <= m1 AND m1 <= m2 AND close >= c1 AND c1 >= c2 THEN -1 ELSE 0 END"}]
_ends = f"CASE WHEN p.side <> 0 AND (p.side * (r.close - p.entry) >= 3 * p.atr0 OR p.side * (r.close - p.entry) <= -2 * p.atr0 OR p.side * (r.macd - r.macd_signal) < 0 OR {_last}) THEN r.close END"
_quiet = f"CASE WHEN p.side = 0 AND NOT ({_last}) AND r.atr IS NOT NULL THEN r.signal ELSE 0 END"
_RANGES = traded("daily_orders", _ranges, _ends, _quiet, {"atr0": "r.atr"}, 0.0)
_plain("bt1_range_trades", lambda s, d: _rounded(backtest.range_trades(sources.daily_orders(s, d))), f"{_RANGES} SELECT {_TRADE} FROM t")
_three = [*_T3, {"h1": L("high"), "h2": L("high", 2), "l1": L("low"), "a8": f"t3_8 - {L('t3_8')}", "a13": f"t3_13 - {L('t3_13')}", "place": RN["rn"]}, {"signal": "CASE WHEN place < 3 THEN 0 WHEN high > h1 AND low > h2 AND h2 > l1 AND (a8 > 0 OR a13 > 0) THEN 1 WHEN high < h1 AND low < h2 AND h2 < l1 AND (a8 < 0 OR a13 < 0) THEN -1 ELSE 0 END"}]
_THREE = traded("by_type", _three, _plan(0.005, 0.003, False), _opens, {}, 0.0)
_plain("bt2_three_bar_trades", lambda s, d: _rounded(backtest.three_bar_trades(sources.by_type(s, d))), f"{_THREE} SELECT {_TRADE} FROM t")
# The account with part positions: what is free after closing, and what a turn makes of it.
_price, _turns = "r.close * (1 + 0.0002 * r.signal)", "(r.signal <> 0 AND r.signal * p.units <= 0)"
_free = f"(p.cash + p.units * {_price} - 0.0005 * abs(p.units) * {_price})"
_units = f"CASE WHEN {_turns} THEN r.signal * {_free} * 0.2 * 0.9995 / ({_price}) ELSE p.units END"
_cash = f"CASE WHEN {_turns} THEN {_free} * (1 - r.signal * 0.2 * 0.9995 - 0.2 * 0.0005) ELSE p.cash END"
_worth = f"({_cash} + ({_units}) * r.close)"
_alive = lambda x: f"CASE WHEN {_worth} > 0 THEN {x} ELSE 0 END"
_first = {"signal": "r.signal", "cash": "CAST(100000 AS DOUBLE)", "units": "CAST(0 AS DOUBLE)", "equity": "CAST(100000 AS DOUBLE)"}
_COSTED = steps("by_type", _SG3, _first, {"signal": "r.signal", "cash": _alive(_cash), "units": _alive(_units), "equity": _alive(_worth)})
_plain(
    "bt4_costed",
    lambda s, d: _rounded(backtest.costed(signals.mfi_turn(sources.by_type(s, d)), size=0.2).select("symbol", "ts", "signal", "cash", "units", "equity")),
    f"{_COSTED} SELECT symbol, ts, signal, round(cash, 6) + 0.0 AS cash, round(units, 6) + 0.0 AS units, round(equity, 6) + 0.0 AS equity FROM s",
)
_past = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_ACCOUNT = f"""{_RANGES}, j AS (SELECT b.symbol, b.ts, b.close, i.side AS i, o.exit AS o FROM {f"({BARS['daily_orders']})"} b LEFT JOIN t i ON i.symbol = b.symbol AND i.entry_ts = b.ts LEFT JOIN t o ON o.symbol = b.symbol AND o.exit_ts = b.ts),
    k AS (SELECT *, coalesce(CASE WHEN count(i) {_past} > count(o) {_past} THEN last_value(i IGNORE NULLS) {_past} * (coalesce(o, close) / nullif({L('close')}, 0) - 1) END, 0) - CASE WHEN i IS NULL THEN 0 ELSE 0.0007 END - CASE WHEN o IS NULL THEN 0 ELSE 0.0007 END AS bar_return FROM j),
    e AS (SELECT *, 100000 * exp(sum(ln(greatest(1 + bar_return, 1e-12))) OVER ({W} ROWS UNBOUNDED PRECEDING)) AS equity FROM k), f AS (SELECT *, equity / greatest(max(equity) OVER ({W} ROWS UNBOUNDED PRECEDING), 100000) - 1 AS drawdown FROM e)"""
_plain("bt4_account", lambda s, d: _rounded(backtest.account(b := sources.daily_orders(s, d), backtest.range_trades(b), cost=0.0007)), f"{_ACCOUNT} SELECT symbol, ts, round(bar_return, 6) + 0.0 AS bar_return, round(equity, 6) AS equity, round(drawdown, 6) + 0.0 AS drawdown FROM f")
_plain(
    "bt4_performance",
    lambda s, d: _rounded(backtest.performance(b := sources.daily_orders(s, d), backtest.range_trades(b), cost=0.0007)),
    f"""{_ACCOUNT}, g AS (SELECT symbol, arg_max(equity, ts) AS final_value, count(*) AS n, stddev_samp(bar_return) * sqrt(252) AS annual_volatility, min(drawdown) AS max_drawdown FROM f GROUP BY 1),
    h AS (SELECT *, final_value / 100000 - 1 AS total_return, pow(final_value / 100000, 252.0 / n) - 1 AS annual_return FROM g),
    u AS (SELECT symbol, count(*) AS n_trades, count(*) FILTER (ret > 0) / count(*) AS win_rate, avg(ret) FILTER (ret > 0) AS avg_win, avg(ret) FILTER (ret <= 0) AS avg_loss, sum(ret) FILTER (ret > 0) / nullif(abs(sum(ret) FILTER (ret <= 0)), 0) AS profit_factor, avg(epoch(exit_ts) - epoch(entry_ts)) / 86400 AS days_held FROM t GROUP BY 1)
    SELECT symbol, round(final_value, 6) AS final_value, round(annual_volatility, 6) AS annual_volatility, round(max_drawdown, 6) AS max_drawdown, round(total_return, 6) AS total_return, round(annual_return, 6) AS annual_return, round(annual_return / nullif(annual_volatility, 0), 6) AS sharpe,
    coalesce(n_trades, 0) AS n_trades, round(win_rate, 6) AS win_rate, round(avg_win, 6) AS avg_win, round(avg_loss, 6) AS avg_loss, round(profit_factor, 6) AS profit_factor, round(days_held, 6) AS days_held FROM h LEFT JOIN u USING (symbol)""",
)
_plain("sg4_latest", lambda s, d: signals.latest(signals.mfi_turn(sources.by_type(s, d))).select("symbol", "ts", "signal", "action"), f"WITH z AS ({sql('by_type', {'signal': 'int'}, _SG3)}) SELECT symbol, ts, signal, CASE signal WHEN 1 THEN 'BUY' WHEN -1 THEN 'SELL' END AS action FROM z QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")
_plain("rel13_signal_counts", lambda s, d: portfolio.signal_counts(signals.mfi_turn(sources.by_type(s, d))), f"WITH z AS ({sql('by_type', {'signal': 'int'}, _SG3)}) SELECT signal, count(*) AS n FROM z GROUP BY 1")
_plain("rel10_heaviest", lambda s, d: _rounded(portfolio.heaviest(portfolio.inverse_volatility(sources.daily_orders(s, d), sources.market(s, d)), 3)), f"WITH z AS ({_ORACLE['pf3_inverse_volatility']}) SELECT * FROM z ORDER BY abs(weight) DESC, symbol LIMIT 3")
_slow_features = [*rsi("close", 14, "rsi"), {"ema_200": E("close", 200), "future_return": f"{D(L('close', -5), 'close')} - 1"}, {"target": "CASE WHEN future_return > 0 THEN 1 ELSE 0 END"}]
add("bt3_slow_mean_and_rsi", "daily_orders", features.slow_mean_and_rsi, "ema_200 rsi future_return target:int", _slow_features)
_plain(
    "sq2_sequences_before",
    lambda s, d: labels.windows_before(labels.three_way(sources.by_type(s, d)), 10).select("symbol", "ts", *[F.round(F.get("sequence", k), 6).alias(f"v{k}") for k in range(10)], F.col("label").cast("int").alias("label")),
    sql("by_type", {**{f"v{k}": "num" for k in range(10)}, "label": "int"}, [{"m": f"{D(L('close', -5), 'close')} - 1", "n": O("count", "close", -10, -1), **{f"v{k}": L("close", 10 - k) for k in range(10)}}, {"label": "CASE WHEN m > 0.002 THEN 2 WHEN m < -0.002 THEN 1 ELSE 0 END"}], "WHERE n = 10"),
)
_plain(
    "sq1_sequences",
    lambda s, d: labels.windows_ending_here(labels.three_way(sources.by_type(s, d)), 10).select("symbol", "ts", *[F.round(F.get("sequence", k), 6).alias(f"v{k}") for k in range(10)], F.col("label").cast("int").alias("label")),
    sql("by_type", {**{f"v{k}": "num" for k in range(10)}, "label": "int"}, [{"m": f"{D(L('close', -5), 'close')} - 1", "n": O("count", "close", -9, 0), **{f"v{k}": L("close", 9 - k) if k < 9 else "close" for k in range(10)}}, {"label": "CASE WHEN m > 0.002 THEN 2 WHEN m < -0.002 THEN 1 ELSE 0 END"}], "WHERE n = 10"),
)
_plain("src5_synthetic", lambda s, d: sources.synthetic(s))


# ---- features and learning ----


def _technical(spark: SparkSession, d: str) -> DataFrame:
    df, names = features.technical(sources.daily_orders(spark, d))
    return shown(df, dict.fromkeys(names, "num"))


def _technical_sql() -> str:
    """The recurrences in one walk over the rows, the other features in tables over it."""
    ema = lambda x, n, was: f"{was} * {num(1 - 2 / (n + 1))} + {x} * {num(2 / (n + 1))}"
    spans, lines = (5, 9, 21, 50, 100, 200), {"line_12_26": (12, 26, 9), "line_5_15": (5, 15, 3)}
    first, step = {f"mean_{n}": "CAST(close AS DOUBLE)" for n in (*spans, 12, 26, 15)}, {f"mean_{n}": ema("r.close", n, f"p.mean_{n}") for n in (*spans, 12, 26, 15)}
    for name, (a, b, n) in lines.items():
        first[f"{name}_signal"], step[f"{name}_signal"] = num(0.0), ema(f"(({step[f'mean_{a}']}) - ({step[f'mean_{b}']}))", n, f"p.{name}_signal")
    held = "CASE WHEN p.up THEN least(p.stop + p.af * (p.ep - p.stop), r.l1, r.l2) ELSE greatest(p.stop + p.af * (p.ep - p.stop), r.h1, r.h2) END"
    turn = f"(CASE WHEN p.up THEN r.low < {held} ELSE r.high > {held} END)"
    first |= {"stop": "CAST(NULL AS DOUBLE)", "ep": "CAST(NULL AS DOUBLE)", "af": num(0.02), "up": "true"}
    step |= {
        "stop": f"CASE WHEN r.rn = 1 THEN r.l1 WHEN {turn} THEN p.ep ELSE {held} END",
        "ep": f"CASE WHEN r.rn = 1 THEN CASE WHEN r.close > r.c1 THEN r.high ELSE r.low END WHEN {turn} THEN CASE WHEN p.up THEN r.low ELSE r.high END WHEN p.up THEN greatest(p.ep, r.high) ELSE least(p.ep, r.low) END",
        "af": f"CASE WHEN r.rn = 1 OR {turn} THEN {num(0.02)} WHEN p.up AND r.high > p.ep OR NOT p.up AND r.low < p.ep THEN least(p.af + {num(0.02)}, {num(0.2)}) ELSE p.af END",
        "up": f"CASE WHEN r.rn = 1 THEN r.close > r.c1 ELSE p.up <> {turn} END",
    }
    walk = steps("daily_orders", [{"h1": L("high"), "h2": L("high", 2), "l1": L("low"), "l2": L("low", 2), "c1": L("close")}], first, step)
    crossed = lambda a, b: f"CASE WHEN {a} > {b} AND {L(a)} <= {L(b)} THEN 1 ELSE 0 END"
    share = lambda k: D(R("sum", "bp", k), R("sum", "tr1", k))
    place = lambda k: f"100 * {D('close - ' + R('min', 'low', k), R('max', 'high', k) + ' - ' + R('min', 'low', k))}"
    high, low = f"(high - {L('high')})", f"({L('low')} - low)"
    five = f"{O('count', 'high', -2, 2)} = 5"
    stages = [
        {k: f"mean_{a} - mean_{b}" for k, (a, b, _) in lines.items()},
        {f"{k}_gap": f"{k} - {k}_signal" for k in lines} | {f"plain_mean_{n}": R("avg", "close", n) for n in (10, 20)} | {f"s{n}": R("stddev_samp", "close", n) for n in (10, 20)} | {f"crossed_{a}_{b}": crossed(f"mean_{a}", f"mean_{b}") for a, b in ((9, 21), (50, 200))},
        {f"close_to_{m}": D("close", m) for m in ("plain_mean_20", "mean_50", "mean_200")} | {f"change_{n}": f"{D('close', L('close', n))} - 1" for n in (5, 10, 20, 50)} | {f"change_percent_{n}": f"100 * ({D('close', L('close', n))} - 1)" for n in (10, 21)},
        {"tr1": f"CASE WHEN {L('close')} IS NOT NULL THEN {TR} END", "tp": TP, "hl": HL2},
        {f"range_{n}": R("avg", "tr1", n) for n in (7, 14, 21)} | {f"band_width_{n}": D(f"4 * s{n}", f"plain_mean_{n}") for n in (10, 20)},
        {"band_place": D("close - plain_mean_20 + 2 * s20", "4 * s20"), "range_percent": f"100 * {D('range_14', 'close')}", **{f"ranges_from_{m}": D(f"close - {m}", "range_14") for m in ("plain_mean_20", "mean_50")}},
        {f"volume_mean_{n}": R("avg", "volume", n) for n in (5, 10, 20)} | {"ov": f"coalesce(sign(close - {L('close')}), 0) * volume", "td": f"tp - {L('tp')}", "mv": f"{D('(close - low) - (high - close)', 'high - low')} * volume"},
        {"volume_change": f"{D('volume', L('volume'))} - 1", **{f"volume_to_{n}": D("volume", f"volume_mean_{n}") for n in (5, 10)}, "obv": CUM("ov"), "tpos": "CASE WHEN td > 0 THEN tp * volume ELSE 0 END", "tneg": "CASE WHEN td < 0 THEN tp * volume ELSE 0 END", "flow_share": D(R("sum", "mv", 20), R("sum", "volume", 20))},
        {f"money_flow_{n}": f"CASE WHEN {R('sum', 'tneg', n)} = 0 AND {R('sum', 'tpos', n)} > 0 THEN 100 ELSE 100 - 100 / (1 + {D(R('sum', 'tpos', n), R('sum', 'tneg', n))}) END" for n in (7, 14)},
    ]
    for n in (2, 7, 14, 21):
        d, gains, whole = rsi("close", n, f"rsi_{n}")
        own = lambda x, n=n: x.replace("coalesce(d, 0)", f"coalesce(d_{n}, 0)").replace("l_ ", f"l_{n} ").replace("l_,", f"l_{n},").replace("g_ ", f"g_{n} ")
        stages += [{f"d_{n}": d["d"]}, {f"g_{n}": own(gains["g_"]), f"l_{n}": own(gains["l_"])}, {f"rsi_{n}": own(whole[f"rsi_{n}"])}]
    stages += [
        {"bp": f"CASE WHEN {L('close')} IS NOT NULL THEN close - least(low, {L('close')}) END"},
        {"ultimate": f"100 * (4 * {share(7)} + 2 * {share(14)} + {share(28)}) / 7", "place_14": place(14), "place_5": place(5)},
        {"place_14_d": R("avg", "place_14", 3), "place_5_d": R("avg", "place_5", 3), "slow_place": R("avg", "place_14", 3)},
        {"slow_place_d": R("avg", "slow_place", 3), "williamsr": f"-100 * {D(R('max', 'high', 14) + ' - close', R('max', 'high', 14) + ' - ' + R('min', 'low', 14))}", "ma": R("avg", "tp", 20)},
        {"apart": "abs(tp - ma)", "ao": f"{R('avg', 'hl', 5)} - {R('avg', 'hl', 34)}"},
        {"cci_20": D("tp - ma", f"0.015 * {R('avg', 'apart', 20)}"), "dp": f"CASE WHEN {high} > {low} THEN greatest({high}, 0) ELSE 0 END", "dm": f"CASE WHEN {low} > {high} THEN greatest({low}, 0) ELSE 0 END"},
        {f"{n}_di_14": f"100 * {D(R('sum', x, 14), R('sum', 'tr1', 14))}" for n, x in (("plus", "dp"), ("minus", "dm"))},
        {"dx": f"100 * {D('abs(plus_di_14 - minus_di_14)', 'plus_di_14 + minus_di_14')}", "fh": f"CASE WHEN {five} THEN {O('max', 'high', -2, 2)} END", "fl": f"CASE WHEN {five} THEN {O('min', 'low', -2, 2)} END", "tenkan": _mid(9), "kijun": _mid(26), "sb": _mid(52)},
        {"adx_14": R("avg", "dx", 14), **{n: f"CASE WHEN {c} {o} {L(c, 5)} THEN 1 ELSE 0 END" for n, c, o in (("higher_high", "fh", ">"), ("lower_low", "fl", "<"), ("higher_low", "fl", ">"), ("lower_high", "fh", "<"))}},
        {"span_a": f"({L('tenkan', 26)} + {L('kijun', 26)}) / 2", "span_b": L("sb", 26), "tenkan_kijun_cross": crossed("tenkan", "kijun"), "stop_distance": f"100 * {D('close - stop', 'close')}"},
        {"above_cloud": "CASE WHEN close > span_a AND close > span_b THEN 1 ELSE 0 END", "below_cloud": "CASE WHEN close < span_a AND close < span_b THEN 1 ELSE 0 END"},
    ]
    parts, last = over("w", stages, "c")
    helpers = {"mean_12", "mean_26", "mean_15", "s10", "s20", "tr1", "tp", "hl", "ov", "td", "mv", "tpos", "tneg", "bp", "ma", "apart", "dp", "dm", "dx", "fh", "fl", "tenkan", "kijun", "sb", "span_a", "span_b", *[f"{c}_{n}" for c in "dgl" for n in (2, 7, 14, 21)]}
    names = [c for c in [*[c for c in first if c not in ("stop", "ep", "af", "up")], *[c for stage in stages for c in stage]] if c not in helpers]
    return f"{walk}, w AS (SELECT b0.*, s.* EXCLUDE (symbol, ts, rn) FROM b0 JOIN s ON s.symbol = b0.symbol AND s.ts = b0.ts), {', '.join(parts)} SELECT symbol, ts, {listed(dict.fromkeys(['open', 'high', 'low', 'close', 'volume', *names], 'num'))} FROM {last}"


_plain("fe1_technical", _technical, _technical_sql())
_flow = [{"tp": TP}, {"d": f"tp - {L('tp')}"}, {"p": "CASE WHEN d > 0 THEN tp * volume ELSE 0 END", "n": "CASE WHEN d < 0 THEN tp * volume ELSE 0 END"}, {"ps": R("sum", "p", 7), "ns": R("sum", "n", 7)}, {"mfi_7": "CASE WHEN ns = 0 AND ps > 0 THEN 100 ELSE 100 - 100 / (1 + ps / nullif(ns, 0)) END"}]
add("fe1_money_flow", "by_type", lambda d: features.money_flow(d, 7, "mfi_7"), "mfi_7", _flow)
_u, _v = f"(high - {L('high')})", f"({L('low')} - low)"
add("fe1_directional_sums", "by_type", features.directional_sums, "plus_di_14 minus_di_14 adx_14", [{"tr": f"CASE WHEN {L('close')} IS NOT NULL THEN {TR} END", "p": f"CASE WHEN {_u} > {_v} THEN greatest({_u}, 0) ELSE 0 END", "m": f"CASE WHEN {_v} > {_u} THEN greatest({_v}, 0) ELSE 0 END"}, {"plus_di_14": f"100 * {D(R('sum', 'p', 14), R('sum', 'tr', 14))}", "minus_di_14": f"100 * {D(R('sum', 'm', 14), R('sum', 'tr', 14))}"}, {"dx": f"100 * {D('abs(plus_di_14 - minus_di_14)', 'plus_di_14 + minus_di_14')}"}, {"adx_14": R("avg", "dx", 14)}])
add("fe1_own_mean_cci", "by_type", features.own_mean_cci, "cci_20", [{"tp": TP}, {"ma": R("avg", "tp", 20)}, {"x": "abs(tp - ma)"}, {"cci_20": D("tp - ma", f"0.015 * {R('avg', 'x', 20)}")}])
_five = f"{O('count', 'high', -2, 2)} = 5"
add("fe1_structure", "by_type", features.structure, "higher_high:int lower_low:int higher_low:int lower_high:int", [{"h": f"CASE WHEN {_five} THEN {O('max', 'high', -2, 2)} END", "l": f"CASE WHEN {_five} THEN {O('min', 'low', -2, 2)} END"}, {n: f"CASE WHEN {c} {o} {L(c, 5)} THEN 1 ELSE 0 END" for n, c, o in (("higher_high", "h", ">"), ("lower_low", "l", "<"), ("higher_low", "l", ">"), ("lower_high", "h", "<"))}])
_BANDS = [{"bb_middle": R("avg", "close", 14), "s": R("stddev_samp", "close", 14)}, {"bb_upper": "bb_middle + 2 * s", "bb_lower": "bb_middle - 2 * s"}, {"bb_bandwidth": D("bb_upper - bb_lower", "bb_middle"), "bb_percent": D("close - bb_lower", "bb_upper - bb_lower")}]
_LINES = [RN, {"support": R("min", "close", 14), "resistance": R("max", "close", 14), "trend": f"CASE WHEN rn >= 14 THEN {O('regr_slope', 'close, rn', -14, -1)} END"}]
add("fe2_levels_and_oscillators", "by_type", features.levels_and_oscillators, "cci tsv macd macd_signal macd_hist rsi support resistance trend bb_middle bb_upper bb_lower bb_bandwidth bb_percent", [*_CCI, *_TSV, *_MACD, {"macd_hist": "macd - macd_signal"}, *rsi("close", 14, "rsi"), *_LINES, *_BANDS])
_WAY = [{"tr": TR}, {"atr": E("tr", 14)}, {"atr_roc": f"100 * {D('atr - ' + L('atr', 14), L('atr', 14))}"}, {"directional_vol": f"CASE WHEN {E('atr_roc', 14)} > 0 THEN 1 ELSE -1 END"}]
for _w, _o, _s in ((1, "directional_vol cci tsv macd uo", [*_HA, *_WAY, *_CCI, *_TSV, *_MACD, *_UO]), (3, "t3_8 t3_13 harris_signal", [*_HA, *_T3, *_HARRIS]), (4, "atr mfi macd", [*_HA, {"tr": TR}, {"atr": E("tr", 10)}, *_MFI10, *_MACD])):
    add(f"fe3_live_{_w}", "by_type", lambda d, w=_w: features.live(d, w), _o, _s)


def _learnable(spark: SparkSession, d: str) -> DataFrame:
    table = labels.split_by_time(labels.next_up(features.levels_and_oscillators(sources.by_type(spark, d))))
    columns = ["cci", "tsv", "macd", "macd_signal", "rsi", "trend", "bb_percent"]
    return learning.assembled(table.withColumn("target", F.col("target").cast("double")), columns)


def _forest(spark: SparkSession, d: str) -> DataFrame:
    table = _learnable(spark, d).cache()
    forest, _ = learning.forest_search(table, trials=50)
    known = learning.dealt(table.where("is_train"))
    return learning.confusion(learning.predicted(forest, known, table.where("not is_train")))


_plain("ml3_components", lambda s, d: learning.components(_learnable(s, d))[0].select("symbol", "ts", F.transform(learning.vector_to_array("pca"), lambda v: F.round(v, 6)).alias("components")))
_plain("ml4_forest", _forest)
_plain("ml6_spread_over_seeds", lambda s, d: learning.spread_over_seeds(_learnable(s, d).cache(), samples=100))
_LEARNED = ["cci", "tsv", "macd", "macd_signal", "rsi", "trend", "bb_percent"]
_folds = lambda kind: lambda s, d: networks.walk_forward(labels.next_up(features.levels_and_oscillators(sources.by_type(s, d))), _LEARNED, kind)
_plain("ml5_dropout", _folds("dropout"))
_plain("ml5_variational", _folds("variational"))
_plain("ml5_recurrent", lambda s, d: networks.walk_forward(networks.sequences(labels.next_up(features.levels_and_oscillators(sources.by_type(s, d))), _LEARNED), "sequence", "recurrent"))
_said = lambda df: labels.next_up(df).withColumn("prediction", F.when(_diff("close") > 0, 1).otherwise(0))
_plain(
    "ml6_report",
    lambda s, d: _rounded(networks.report(_said(sources.by_type(s, d)))),
    f"""WITH q AS (SELECT CASE WHEN {L('close', -1)} / nullif(close, 0) - 1 > 0 THEN 1 ELSE 0 END AS a, CASE WHEN close - {L('close')} > 0 THEN 1 ELSE 0 END AS p FROM ({BARS['by_type']})),
    t AS (SELECT a, p FROM q), c AS (SELECT unnest([0, 1]) AS class)
    SELECT CAST(class AS INTEGER) AS class, round(count(*) FILTER (a = class AND p = class) / nullif(count(*) FILTER (p = class), 0), 6) AS precision, round(count(*) FILTER (a = class AND p = class) / nullif(count(*) FILTER (a = class), 0), 6) AS recall,
    round(2 * count(*) FILTER (a = class AND p = class) / nullif(count(*) FILTER (a = class) + count(*) FILTER (p = class), 0), 6) AS f1, count(*) FILTER (a = class) AS support, round(count(*) FILTER (a = p) / count(*), 6) AS accuracy FROM t, c GROUP BY class""",
)
_plain("ml8_walk_forward", lambda s, d: learning.walk_forward(labels.windows_ending_here(labels.three_way(sources.by_type(s, d)), 40)))
_plain("ml8_kernels_walk_forward", lambda s, d: learning.walk_forward(labels.windows_ending_here(labels.three_way(sources.by_type(s, d)), 40), kind="kernels"))
_plain("ml5_kernel_parts", lambda s, d: additive.parts(sources.by_type(s, d)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
