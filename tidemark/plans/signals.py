"""Rules over daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import signals as S
from tidemark.plans import _data as D
from tidemark.plans._data import q_ewm, q_frame, q_lag, q_roll

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _rule(key: str, name: str, ctes: list[str], entry: str, exit_: str, **parameters) -> None:
    """ctes: ``name AS (...)`` in order, the first reading ``bars``; the last one is read by the flags."""
    QUERIES[key] = lambda spark, d: S.apply_rule(D.daily(spark, d), name, **parameters).select("symbol", "ts", "entry", "exit")
    last = "bars"
    body = [D.DAILY]
    for c in ctes:
        body.append(c)
        last = c.rsplit("\n", 1)[-1].split(" AS ", 1)[0].split(" AS (", 1)[0].strip() if "_n AS" in c else c.split(" AS (", 1)[0].strip()
    SQL[key] = f"WITH {', '.join(body)} SELECT symbol, ts, coalesce({entry}, false)::INT AS entry, coalesce({exit_}, false)::INT AS exit FROM {last}"


def up(c):
    return f"{c} > {q_lag(c)}"


def down(c):
    return f"{c} < {q_lag(c)}"


def over(c, k):
    return f"({q_lag(c)} <= {k} AND {c} > {k})"


def a(source, name, **cols):
    return f"{name} AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {source})"


def plus(source, name, ewms: dict[str, tuple[str, float]]):
    """CTEs that add exponential means of columns of ``source``."""
    made = [q_ewm(f"{name}_{c}", source, x, alpha) for c, (x, alpha) in ewms.items()]
    joins = " ".join(f"LEFT JOIN {name}_{c} ON {name}_{c}.symbol = s.symbol AND {name}_{c}.ts = s.ts" for c in ewms)
    return ", ".join(made) + f",\n{name} AS (SELECT s.*, {', '.join(f'{name}_{c}.y AS {c}' for c in ewms)} FROM {source} s {joins})"


P = q_lag("close")
TR = f"CASE WHEN {P} IS NULL THEN high - low ELSE greatest(high - low, abs(high - {P}), abs(low - {P})) END"
GAIN = {"gain": f"CASE WHEN {P} IS NOT NULL THEN greatest(close - {P}, 0) END", "loss": f"CASE WHEN {P} IS NOT NULL THEN greatest({P} - close, 0) END"}
WILDER = [a("bars", "d", **GAIN), plus("d", "e", {"g": ("gain", 1 / 14), "l": ("loss", 1 / 14)}), a("e", "f", rsi="100 - 100 / (1 + g / (l + 1e-12))")]
SIMPLE = [a("bars", "d", **GAIN), a("d", "e", g=q_roll("avg", "gain", 14), l=q_roll("avg", "loss", 14)), a("e", "f", rsi="CASE WHEN l IS NOT NULL THEN coalesce(100 - 100 / (1 + g / nullif(l, 0)), 50) END")]
WR = [a("bars", "d", t=q_roll("max", "high", 14, 1), b=q_roll("min", "low", 14, 1)), a("d", "e", wr="-100 * (t - close) / (t - b + 1e-12)")]

_rule("F01_donchian", "donchian", [a("bars", "d", t=q_roll("max", "high", 40, 1), b=q_roll("min", "low", 40, 1))], f"close > {q_lag('t')}", f"close < {q_lag('b')}")
_rule("F02_cci", "cci", [a("bars", "d", tp="(high + low + close) / 3"), a("d", "d2", m=q_roll("avg", "tp", 20, 1), v=f"list(tp) {q_frame(20)}"), a("d2", "e", cci="CASE WHEN abs(tp - m) > 1e-12 * abs(tp) THEN tp - m ELSE 0 END / (0.015 * list_avg(list_transform(v, lambda x: abs(x - m))) + 1e-12)")], f"cci > 0 AND {up('cci')}", f"cci < 0 AND {down('cci')}")
_UP, _DOWN = f"(high - {q_lag('high')})", f"({q_lag('low')} - low)"
REI = [a("bars", "d", u=f"CASE WHEN {_UP} > 0 AND {_UP} > {_DOWN} THEN {_UP} ELSE 0 END", w=f"CASE WHEN {_DOWN} > 0 AND {_DOWN} > {_UP} THEN {_DOWN} ELSE 0 END", r="high - low"), a("d", "d2", su=q_roll("sum", "u", 14, 1), sw=q_roll("sum", "w", 14, 1), mr=q_roll("avg", "r", 14, 1)), a("d2", "e", rei="100 * CASE WHEN abs(su - sw) > 1e-12 * abs(high) THEN su - sw ELSE 0 END / (mr + 1e-12)")]
_rule("F03_rei", "rei", REI, f"rei > 0 AND {up('rei')}", "rei < -20")
_rule("F04_williams_r", "williams_r", WR, over("wr", -80), over("wr", -20))
_rule("F04_williams_r_legacy", "williams_r_legacy", WR, f"wr > -80 AND {up('wr')}", f"wr < -20 AND {down('wr')}")
_rule("F06_tsi", "tsi", [a("bars", "d", m=f"close - {P}", am=f"abs(close - {P})"), plus("d", "e", {"m1": ("m", 1 / 7), "a1": ("am", 1 / 7)}), plus("e", "f", {"m2": ("m1", 1 / 7), "a2": ("a1", 1 / 7)}), a("f", "g", tsi="CASE WHEN a2 <> 0 THEN round(100 * m2 / a2, 9) END")], f"tsi > 0 AND {up('tsi')}", f"tsi < -10 AND {down('tsi')}")
_rule("F07_bop", "bop", [a("bars", "d", bop="(close - low) / (high - low + 1e-12)"), a("d", "e", s=f"round({q_roll('avg', 'bop', 20)}, 12)")], f"bop > 0 AND {up('s')}", "bop < -0.2")
_rule("F08_mtf_confirm", "mtf_confirm", [a("bars", "d", f=q_roll("avg", "close", 50, 1), s=q_roll("avg", "close", 200, 1))], "f > s AND close > f", "close < f")
_rule("F11_chandelier", "chandelier", [a("bars", "d", tr=TR), a("d", "e", stop=f"{q_roll('max', 'high', 22, 1)} - 3 * {q_roll('avg', 'tr', 22, 1)}")], "false", f"close < {q_lag('stop')}")
_rule("F12_atr_trail", "atr_trail", [a("bars", "d", tr=TR), a("d", "e", stop=f"max(high) {D.SOFAR} - 2 * {q_roll('avg', 'tr', 14, 1)}")], "false", f"close < {q_lag('stop')}")
_rule("F13_rsi", "rsi", WILDER, "rsi < 30", over("rsi", 50))
_rule("F14_rsi_jump", "rsi_jump", SIMPLE, f"{q_lag('rsi')} < 45 AND rsi > 55", "rsi > 70")
_rule("F15_stochastic", "stochastic", [a("bars", "d", t=q_roll("max", "high", 14, 1), b=q_roll("min", "low", 14, 1)), a("d", "e", k="100 * (close - b) / (t - b + 1e-12)")], over("k", 20), over("k", 80))
_rule("F16_mfi", "mfi", [a("bars", "d", tp="(high + low + close) / 3"), a("d", "d2", u=f"CASE WHEN tp > {q_lag('tp')} THEN tp * volume ELSE 0 END", w=f"CASE WHEN tp < {q_lag('tp')} THEN tp * volume ELSE 0 END"), a("d2", "d3", su=q_roll("sum", "u", 14, 1), sw=q_roll("sum", "w", 14, 1)), a("d3", "e", mfi="100 - 100 / (1 + su / (sw + 1e-12))")], over("mfi", 20), over("mfi", 80))
_rule("F17_inverse_fisher_rsi", "inverse_fisher_rsi", [*WILDER, a("f", "g2", v="(rsi / 100 - 0.5) * 2"), a("g2", "h", sv=q_roll("avg", "v", 5, 1)), a("h", "i", ifr="(exp(2 * sv) - 1) / (exp(2 * sv) + 1)")], over("ifr", -0.5), over("ifr", 0.5))
CROSS = f"close > ma AND {P} <= {q_lag('ma')}"
MA = a("bars", "d", ma=q_roll("avg", "close", 30, 1))
RET = a("d", "d2", r=f"close / nullif({P}, 0) - 1")
VOL = a("d2", "d3", vol=q_roll("stddev_samp", "r", 20, 5))
_rule("F18_ma_recapture", "ma_recapture", [MA], CROSS, "close < ma")
_rule("F18_ma_recapture_ema", "ma_recapture_ema", [plus("bars", "d", {"ma": ("close", 2 / 31)})], CROSS, "close < ma")
_rule("F18_ma_recapture_rising", "ma_recapture_rising", [MA], f"{CROSS} AND {up('ma')}", "close < ma")
_rule("F18_ma_recapture_dual", "ma_recapture_dual", [a("bars", "d", ma=q_roll("avg", "close", 30, 1), s=q_roll("avg", "close", 50, 1))], f"{CROSS} AND close > s", "close < ma")
_rule("F18_ma_recapture_low_vol", "ma_recapture_low_vol", [MA, RET, VOL, a("d3", "d4", q=q_roll("quantile_cont({}, 0.5)", "vol", 40, 20))], f"{CROSS} AND vol < q", "close < ma")
_rule("F18_ma_recapture_vol_expand", "ma_recapture_vol_expand", [MA, RET, VOL], f"{CROSS} AND vol > {q_lag('vol')}", "close < ma")
_rule("F18_ma_recapture_high_volume", "ma_recapture_high_volume", [a("bars", "d", ma=q_roll("avg", "close", 30, 1), mv=q_roll("avg", "volume", 20, 10))], f"{CROSS} AND volume > mv", "close < ma")
_rule("F18_ma_recapture_surge", "ma_recapture_surge", [a("bars", "d", ma=q_roll("avg", "close", 30, 1), mv=q_roll("avg", "volume", 20, 10))], f"{CROSS} AND volume >= 1.5 * mv", "close < ma")
BB = [a("bars", "d", mid=q_roll("avg", "close", 20), sd=q_roll("stddev_samp", "close", 20)), a("d", "e", u="mid + 2 * sd", l="mid - 2 * sd"), a("e", "f", w="CASE WHEN mid <> 0 THEN (u - l) / mid END")]
_rule("F19_bollinger", "bollinger", BB, "close > u", "close < mid")
_rule("F19_bbwp", "bbwp", [*BB, a("f", "g", vs=f"list(w) {q_frame(50)}", n=f"count(*) {q_frame(50)}", nw=f"count(w) {q_frame(50)}"), a("g", "h", wp="CASE WHEN nw >= 5 AND w IS NOT NULL THEN len(list_filter(vs, lambda x: x <= w)) / n END")], "close > u AND wp > 0.8", "close < l OR wp < 0.2")
_rule("F20_mr_bounce", "mr_bounce", SIMPLE, f"rsi < 30 AND close / nullif({q_lag('close', 5)}, 0) - 1 < -0.1", "false")
_rule("F21_obv", "obv", [a("bars", "d", s=f"CASE WHEN close > {P} THEN volume WHEN close < {P} THEN -volume ELSE 0 END"), a("d", "d2", o=f"sum(s) {D.SOFAR}"), a("d2", "e", ma=q_roll("avg", "o", 20, 1))], f"o > ma AND {up('o')}", f"o < ma AND {down('o')}")
_rule("F22_efi", "efi", [a("bars", "d", fo=f"coalesce(close - {P}, 0) * volume"), a("d", "e", s=q_roll("avg", "fo", 20, 1))], f"fo > 0 AND {up('s')}", "fo < 0")
_rule("F23_roc", "roc", [a("bars", "d", x=f"100 * (close / nullif({q_lag('close', 10)}, 0) - 1)")], "x > 5", "x < -5")
E3 = [plus("bars", "t1", {"e1": ("close", 2 / 16)}), plus("t1", "t2", {"e2": ("e1", 2 / 16)}), plus("t2", "t3", {"e3": ("e2", 2 / 16)})]
_rule("F24_trix", "trix", [*E3, a("t3", "t4", x=f"round(100 * (e3 / {q_lag('e3')} - 1), 9)")], f"x > 0 AND {up('x')}", "x < 0")
S3 = [plus("bars", "t1", {"e1": ("close", 2 / 11)}), plus("t1", "t2", {"e2": ("e1", 2 / 11)}), plus("t2", "t3", {"e3": ("e2", 2 / 11)})]
_rule("F25_supertrend", "supertrend", [*S3, a("t3", "t4", u="(high + low) / 2 - 3 * e3", l="(high + low) / 2 + 3 * e3"), a("t4", "t5", side=f"CASE WHEN close > {q_lag('u')} THEN 1 WHEN close < {q_lag('l')} THEN -1 END"), a("t5", "t6", st=f"coalesce(last_value(side IGNORE NULLS) {D.SOFAR}, 0)")], f"st = 1 AND {up('st')}", f"st = -1 AND {down('st')}")
_rule("F26_chandelier_flip", "chandelier_flip", [*S3, a("t3", "f", u=f"coalesce(close > {q_roll('max', 'high', 22, 1)} - 3 * e3, false)::INT")], f"{q_lag('u')} = 0 AND u = 1", f"{q_lag('u')} = 1 AND u = 0")
MID = {n: f"({q_roll('max', 'high', n, 1)} + {q_roll('min', 'low', n, 1)}) / 2" for n in (9, 26, 52)}
_rule("F27_ichimoku", "ichimoku", [a("bars", "d", t=MID[9], k=MID[26], b=MID[52])], "t > k AND close > greatest((t + k) / 2, b)", "close < k")
_rule("F28_liquid_cross", "liquid_cross", [a("bars", "d", f=q_roll("avg", "close", 20), s=q_roll("avg", "close", 50)), a("d", "e", adv=q_roll("avg", "volume", 20)), a("e", "g", fl="quantile_cont(coalesce(adv, 0), 0.7) OVER (PARTITION BY ts)")], f"f > s AND {up('f')} AND adv > fl", "f < s")
ENS = a("bars", "d", ma=q_roll("avg", "close", 50), **{f"t{n}": q_roll("max", "high", n, 1) for n in (20, 40, 60, 90)}, **{f"b{n}": q_roll("min", "low", n, 1) for n in (20, 40, 60, 90)})
_rule("F32_donchian_ensemble", "donchian_ensemble", [ENS], "(" + " OR ".join(f"coalesce(close > {q_lag(f't{n}')}, false)" for n in (20, 40, 60, 90)) + ") AND close >= ma", " OR ".join(f"coalesce(close < {q_lag(f'b{n}')}, false)" for n in (20, 40, 60, 90)))
_rule("F32_donchian_volume", "donchian_ensemble", [ENS], "(" + " OR ".join(f"coalesce(close > {q_lag(f't{n}')}, false)" for n in (20, 40, 60, 90)) + f") AND close >= ma AND {q_lag('volume')} > 0 AND volume >= {q_lag('volume')}", " OR ".join(f"coalesce(close < {q_lag(f'b{n}')}, false)" for n in (20, 40, 60, 90)), filter_volume=True)
_rule("F33_slow_momentum", "slow_momentum", [a("bars", "d", m=f"close / nullif({q_lag('close', 60)}, 0) - 1")], "m > 0", "m <= 0")
_rule("F34_dispatch_by_alias", "stc", [a("bars", "d", x=f"100 * (close / nullif({q_lag('close', 10)}, 0) - 1)")], "x > 5", "x < -5")


def _wide(key, make, names, ctes, columns):
    QUERIES[key] = lambda spark, d: make(D.daily(spark, d)).select("symbol", "ts", *names)
    last = ctes[-1].rsplit("\n", 1)[-1].split(" AS (", 1)[0].strip()
    SQL[key] = f"WITH {', '.join([D.DAILY, *ctes])} SELECT symbol, ts, {', '.join(f'{e} AS {n}' for n, e in zip(names, columns, strict=True))} FROM {last}"


def side(u, d):
    return f"CASE WHEN coalesce({u}, false) THEN 1 WHEN coalesce({d}, false) THEN -1 ELSE 0 END"


_wide("F09_atr", lambda b: S.atr(b).withColumn("atr", F.round("atr", 4)).withColumn("tr", F.round("tr", 4)), ["tr", "atr"], [a("bars", "d", t=TR), a("d", "e", m=q_roll("avg", "t", 14, 1))], ["round(t, 4)", "round(m, 4)"])
DM = a("bars", "d", t=TR, u=f"high - {q_lag('high')}", w=f"{q_lag('low')} - low")
DM2 = a("d", "d2", p="CASE WHEN u > w AND u > 0 THEN u ELSE 0 END", m="CASE WHEN w > u AND w > 0 THEN w ELSE 0 END")
DX = "CASE WHEN st <> 0 AND sp + sm <> 0 THEN 100 * abs(sp - sm) / (sp + sm) END"
_wide("F10_adx", lambda b: S.directional(b).withColumn("adx", F.round("adx", 6)), ["adx"], [DM, DM2, a("d2", "d3", st=q_roll("avg", "t", 14), sp=q_roll("avg", "p", 14), sm=q_roll("avg", "m", 14)), a("d3", "d4", dx=DX), a("d4", "d5", x=q_roll("avg", "dx", 14))], ["round(x, 6)"])
_wide("F10_adx_exponential", lambda b: S.directional(b, smooth="ewm").withColumn("adx", F.round("adx", 6)), ["adx"], [DM, DM2, plus("d2", "d3", {"st": ("t", 1 / 14), "sp": ("p", 1 / 14), "sm": ("m", 1 / 14)}), a("d3", "d4", dx=DX), plus("d4", "d5", {"x": ("dx", 1 / 14)})], ["round(x, 6)"])
_wide("F12_trail_overlay", lambda b: S.with_trail(S.donchian(b)), ["entry", "exit"], [a("bars", "d", t=q_roll("max", "high", 40, 1), b=q_roll("min", "low", 40, 1), tr=TR), a("d", "e", stop=f"max(high) {D.SOFAR} - 2 * {q_roll('avg', 'tr', 14, 1)}")], [f"coalesce(close > {q_lag('t')}, false)::INT", f"(coalesce(close < {q_lag('b')}, false) OR coalesce(close < {q_lag('stop')}, false))::INT"])
RULES29 = [*WILDER, a("f", "g2", bars="count(*) OVER (PARTITION BY symbol)", s20=q_roll("avg", "close", 20), s50=q_roll("avg", "close", 50), v20=q_roll("avg", "volume", 20), hi=q_roll("max", "high", 20), lo=q_roll("min", "low", 20), mom=f"close / nullif({q_lag('close', 14)}, 0) - 1"), plus("g2", "g3", {"ef": ("close", 2 / 13), "es": ("close", 2 / 27)}), a("g3", "g4", macd="ef - es"), plus("g4", "g5", {"ms": ("macd", 0.2)})]
_wide("F29_directional_rules", S.directional_rules, ["sma_cross", "rsi_volume", "volume_breakout", "channel", "momentum"], RULES29[:4], [side("s20 > s50 AND volume > 1.2 * v20", "NOT coalesce(s20 > s50, false) AND volume > 1.2 * v20"), side("rsi > 55 AND volume > 1.2 * v20", "rsi < 45 AND volume > 1.2 * v20"), side(f"volume > 1.5 * v20 AND close > {q_lag('hi')}", f"volume > 1.5 * v20 AND close < {q_lag('lo')}"), side(f"close > {q_lag('hi')}", f"close < {q_lag('lo')}"), side("mom > 0", "mom < 0")])
_wide("F29_macd", lambda b: S.macd(b).withColumn("macd", F.round("macd", 4)).withColumn("macd_signal", F.round("macd_signal", 4)), ["macd", "macd_signal"], [plus("bars", "g3", {"ef": ("close", 2 / 13), "es": ("close", 2 / 27)}), a("g3", "g4", m="ef - es"), plus("g4", "g5", {"ms": ("m", 0.2)})], ["round(m, 4)", "round(ms, 4)"])
SH = {n: q_roll("avg({}::DOUBLE)", "up", n) for n in (14, 28, 56)}
_wide("F30_triple_up_share", S.triple_up_share, ["held"], [a("bars", "d", up=f"CASE WHEN {P} IS NOT NULL THEN (close / {P} - 1 > 0)::INT END"), a("d", "e", x=SH[14], y=SH[28], z=SH[56]), a("e", "f", sd="CASE WHEN x > 0.5 AND y > 0.5 AND z > 0.5 THEN 1 ELSE 0 END")], [f"coalesce(last_value(nullif(sd, 0) IGNORE NULLS) {D.SOFAR}, 0)"])
S30 = [
    a("bars", "d", bars="count(*) OVER (PARTITION BY symbol)", up=f"CASE WHEN {P} IS NOT NULL THEN (close / {P} - 1 > 0)::INT END", ov=f"coalesce({q_roll('avg', 'close', 20)} > {q_roll('avg', 'close', 50)}, false)::INT", hi=q_roll("max", "high", 20), lo=q_roll("min", "low", 20), v20=q_roll("avg", "volume", 20), mom=f"close / nullif({q_lag('close', 10)}, 0) - 1"),
    plus("d", "e", {"ef": ("close", 2 / 13), "es": ("close", 2 / 27)}), a("e", "g", m="ef - es"), plus("g", "h", {"ms": ("m", 0.2)}),
    a("h", "i", p1=f"CASE WHEN bars >= 50 AND ov = 1 AND {q_lag('ov')} = 0 THEN 1 END", p2=f"CASE WHEN bars >= 56 AND {SH[14]} > 0.5 AND {SH[28]} > 0.5 AND {SH[56]} > 0.5 THEN 1 END", p3=f"CASE WHEN bars >= 20 AND close < {q_lag('lo')} THEN -1 WHEN bars >= 20 AND close > {q_lag('hi')} THEN 1 END", p4="CASE WHEN bars >= 11 AND mom > 0 THEN 1 END", p5=f"CASE WHEN bars >= 20 AND volume > 1.5 * {q_lag('v20')} THEN 1 END", p6="CASE WHEN bars >= 35 AND m > ms THEN 1 END"),
]
_wide("F30_sticky_rules", S.sticky_rules, ["sma_cross", "triple", "channel", "momentum", "volume_breakout", "macd"], S30, [f"coalesce(last_value(p{k} IGNORE NULLS) {D.SOFAR}, 0)" for k in range(1, 7)])
M31 = [*WILDER, a("f", "g2", r=f"close / nullif({P}, 0) - 1", mom=f"close / nullif({q_lag('close', 14)}, 0) - 1", m1=f"close / nullif({q_lag('close', 10)}, 0) - 1", m2=f"close / nullif({q_lag('close', 30)}, 0) - 1", v20=q_roll("avg", "volume", 20)), a("g2", "g3", vol=q_roll("stddev_samp", "r", 20), am="abs(mom)"), a("g3", "g4", v100=q_roll("avg", "vol", 100), q=q_roll("quantile_cont({}, 0.4)", "am", 100))]
_wide("F31_momentum_variants", S.momentum_variants, ["baseline", "vol_scaled", "rsi_filter", "double", "volume_confirm", "adaptive"], M31, [side("mom > 0", "mom < 0"), f"CASE WHEN vol > 2.5 * v100 THEN 0 ELSE {side('mom > 0', 'mom < 0')} END", side("mom > 0 AND rsi > 50", "mom < 0 AND rsi < 50"), side("m1 > 0 AND m2 > 0", "m1 < 0 AND m2 < 0"), side("mom > 0 AND volume > 1.2 * v20", "mom < 0 AND volume > 1.2 * v20"), side("mom > 0 AND am > q", "mom < 0 AND am > q")])
_wide("F35_strength_donchian", lambda b: S.strength(b, "donchian").withColumn("strength", F.round("strength", 6)), ["strength"], [a("bars", "d", t=q_roll("max", "high", 40, 1))], [f"round(100 * (close - {q_lag('t')}) / ({q_lag('t')} + 1e-12), 6)"])
_wide("F35_strength_ema", lambda b: S.strength(b, "ema").withColumn("strength", F.round("strength", 6)), ["strength"], [plus("bars", "d", {"ma": ("close", 2 / 31)})], ["round(100 * (close - ma) / (ma + 1e-12), 6)"])
_wide("F35_strength_williams", lambda b: S.strength(b, "williams_r").withColumn("strength", F.round("strength", 6)), ["strength"], WR, [f"round(greatest(0, 2 * coalesce(wr - {q_lag('wr')}, 0)) - wr, 6)"])
# a flat range makes REI huge, so its logarithm is compared
_wide("F35_strength_rei", lambda b: S.strength(b, "rei").withColumn("log_strength", F.round(F.signum("strength") * F.log1p(F.abs("strength")), 6) + F.lit(0.0)), ["log_strength"], [*REI, a("e", "f", g=f"rei + greatest(0, 0.5 * coalesce(rei - {q_lag('rei')}, 0))")], ["round(sign(g) * ln(1 + abs(g)), 6) + 0"])
