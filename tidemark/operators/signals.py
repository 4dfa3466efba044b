"""Trading rules: each adds entry and exit flags (0 or 1) to bars. Rules are looked up by name in a registry."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import change, cross_up, diff, ewm, flag, lag, mean_deviation, percent_rank, quantile, roll, running, sma, std, up_share

Rule = Callable[[DataFrame], DataFrame]
RULES: dict[str, Rule] = {}
ALIASES: dict[str, str] = {}
C, H, L, V = "close", "high", "low", "volume"


def register(name: str, *aliases: str) -> Callable[[Rule], Rule]:
    """Adds a rule; user rules register the same way."""

    def add(rule: Rule) -> Rule:
        RULES[name] = rule
        ALIASES.update({a: name for a in aliases})
        return rule

    return add


def apply_rule(bars: DataFrame, name: str, **parameters) -> DataFrame:
    known = RULES.get(ALIASES.get(name, name))
    if known is None:
        raise ValueError(f"unknown rule {name!r}; known: {sorted(RULES)}")
    return known(bars, **parameters)


def signals(df: DataFrame, entry: Column, exit_: Column) -> DataFrame:
    return df.withColumn("entry", flag(entry)).withColumn("exit", flag(exit_))


#: Keeps denominators from being zero (fixed value of the rules).
TINY = 1e-12


def true_range() -> Column:
    """The first bar of a symbol has no close before it and ranges from low to high."""
    return F.greatest(F.col(H) - F.col(L), F.abs(F.col(H) - lag(C)), F.abs(F.col(L) - lag(C)))


def rising(c: str) -> Column:
    return F.col(c) > lag(c)


def falling(c: str) -> Column:
    return F.col(c) < lag(c)


@register("donchian", "breakout")
def donchian(df, n: int = 40):
    df = df.withColumn("top", roll(F.max, H, n, 1)).withColumn("bottom", roll(F.min, L, n, 1))
    return signals(df, F.col(C) > lag("top"), F.col(C) < lag("bottom"))


def _settled(x: Column, price: str) -> Column:
    """0 where a difference of sums is within the last bits of the price, as on a flat series."""
    return F.when(F.abs(x) > 1e-12 * F.abs(price), x).when(x.isNotNull(), 0.0)


@register("cci")
def cci(df, n: int = 20):
    df = df.withColumn("typical", (F.col(H) + F.col(L) + F.col(C)) / 3)
    away = _settled(F.col("typical") - sma("typical", n, 1), "typical")
    df = df.withColumn("cci", away / (0.015 * mean_deviation("typical", n, 1) + TINY))
    return signals(df, (F.col("cci") > 0) & rising("cci"), (F.col("cci") < 0) & falling("cci"))


@register("rei")
def rei(df, n: int = 14):
    up, down = diff(H), -diff(L)
    df = df.withColumn("up", F.when((up > 0) & (up > down), up).otherwise(0.0)).withColumn("down", F.when((down > 0) & (down > up), down).otherwise(0.0)).withColumn("range", F.col(H) - F.col(L))
    moved = _settled(roll(F.sum, "up", n, 1) - roll(F.sum, "down", n, 1), H)
    df = df.withColumn("rei", 100 * moved / (sma("range", n, 1) + TINY))
    return signals(df, (F.col("rei") > 0) & rising("rei"), F.col("rei") < -20)


def _williams(df, n):
    top, low = roll(F.max, H, n, 1), roll(F.min, L, n, 1)
    return df.withColumn("wr", -100 * (top - F.col(C)) / (top - low + TINY))


@register("williams_r")
def williams_r(df, n: int = 14):
    df = _williams(df, n)
    return signals(df, cross_up("wr", -80), cross_up("wr", -20))


@register("williams_r_legacy")
def williams_r_legacy(df, n: int = 14):
    df = _williams(df, n)
    return signals(df, (F.col("wr") > -80) & rising("wr"), (F.col("wr") < -20) & falling("wr"))


@register("tsi")
def tsi(df, n: int = 13):
    df = df.withColumn("m", diff(C)).withColumn("am", F.abs("m"))
    for a, b in (("m", "m1"), ("m1", "m2"), ("am", "a1"), ("a1", "a2")):
        df = ewm(df, a, b, span=n)
    df = df.withColumn("tsi", F.when(F.col("a2") != 0, F.round(100 * F.col("m2") / F.col("a2"), 9)))
    return signals(df, (F.col("tsi") > 0) & rising("tsi"), (F.col("tsi") < -10) & falling("tsi"))


@register("bop")
def bop(df, n: int = 20):
    df = df.withColumn("bop", (F.col(C) - F.col(L)) / (F.col(H) - F.col(L) + TINY)).withColumn("smooth", F.round(sma("bop", n), 12))  # equal means stay equal
    return signals(df, (F.col("bop") > 0) & rising("smooth"), F.col("bop") < -0.2)


@register("mtf_confirm")
def mtf_confirm(df, fast: int = 50, slow: int = 200):
    df = df.withColumn("fast", sma(C, fast, 1)).withColumn("slow", sma(C, slow, 1))
    return signals(df, (F.col("fast") > F.col("slow")) & (F.col(C) > F.col("fast")), F.col(C) < F.col("fast"))


def atr(df: DataFrame, n: int = 14, out: str = "atr") -> DataFrame:
    """Adds the true range ``tr`` and its simple mean."""
    return df.withColumn("tr", true_range()).withColumn(out, sma("tr", n, 1))


def directional(df: DataFrame, n: int = 14, smooth: str = "sma") -> DataFrame:
    """Adds adx, in its simple-mean or exponential (alpha 1/n) form."""
    up, down = diff(H), -diff(L)
    df = df.withColumn("tr", true_range())
    df = df.withColumn("plus", F.when((up > down) & (up > 0), up).otherwise(0.0)).withColumn("minus", F.when((down > up) & (down > 0), down).otherwise(0.0))
    if smooth == "sma":
        for c in ("tr", "plus", "minus"):
            df = df.withColumn(f"s_{c}", sma(c, n))
    else:
        for c in ("tr", "plus", "minus"):
            df = ewm(df, c, f"s_{c}", alpha=1 / n)
    p, m = F.col("s_plus") / F.col("s_tr"), F.col("s_minus") / F.col("s_tr")
    df = df.withColumn("dx", F.when((F.col("s_tr") != 0) & (p + m != 0), 100 * F.abs(p - m) / (p + m)))
    return df.withColumn("adx", sma("dx", n)) if smooth == "sma" else ewm(df, "dx", "adx", alpha=1 / n)


@register("chandelier")
def chandelier(df, n: int = 22, k: float = 3.0):
    df = atr(df, n).withColumn("stop", roll(F.max, H, n, 1) - k * F.col("atr"))
    return signals(df, F.lit(False), F.col(C) < lag("stop"))


@register("atr_trail")
def atr_trail(df, n: int = 14, k: float = 2.0):
    df = atr(df, n).withColumn("stop", running(F.max, H) - k * F.col("atr"))
    return signals(df, F.lit(False), F.col(C) < lag("stop"))


def with_trail(df: DataFrame, n: int = 14, k: float = 2.0) -> DataFrame:
    """Signals whose exit also comes when a trailing stop is passed."""
    own = df.withColumnsRenamed({"entry": "own_entry", "exit": "own_exit"})
    return atr_trail(own, n, k).withColumn("exit", F.greatest("own_exit", "exit")).withColumn("entry", F.col("own_entry")).drop("own_entry", "own_exit")


def rsi_wilder(df: DataFrame, n: int = 14, out: str = "rsi") -> DataFrame:
    """Exponential means from the second bar on; 0 while nothing was gained, on a flat series too."""
    d = diff(C)
    df = df.withColumn("gain", F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))).withColumn("loss", F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))))
    df = ewm(ewm(df, "gain", "g", alpha=1 / n), "loss", "l", alpha=1 / n)
    return df.withColumn(out, 100 - 100 / (1 + F.col("g") / (F.col("l") + TINY)))


def rsi_simple(df: DataFrame, n: int = 14, out: str = "rsi") -> DataFrame:
    """Simple means; 50 where there was no loss."""
    d = diff(C)
    df = df.withColumn("gain", F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))).withColumn("loss", F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))))
    g, s = sma("gain", n), sma("loss", n)
    return df.withColumn(out, F.when(s.isNotNull(), F.coalesce(100 - 100 / (1 + g / F.nullif(s, F.lit(0.0))), F.lit(50.0))))


@register("rsi")
def rsi(df, n: int = 14):
    df = rsi_wilder(df, n)
    return signals(df, F.col("rsi") < 30, cross_up("rsi", 50))


@register("rsi_jump")
def rsi_jump(df, n: int = 14, low: float = 45, high: float = 55, leave: float = 70):
    df = rsi_simple(df, n)
    return signals(df, (lag("rsi") < low) & (F.col("rsi") > high), F.col("rsi") > leave)


@register("stochastic")
def stochastic(df, n: int = 14):
    top, low = roll(F.max, H, n, 1), roll(F.min, L, n, 1)
    df = df.withColumn("k", 100 * (F.col(C) - low) / (top - low + TINY))
    return signals(df, cross_up("k", 20), cross_up("k", 80))


@register("mfi")
def mfi(df, n: int = 14):
    df = df.withColumn("typical", (F.col(H) + F.col(L) + F.col(C)) / 3).withColumn("flow", F.col("typical") * F.col(V))
    up = F.when(F.col("typical") > lag("typical"), F.col("flow")).otherwise(0.0)
    down = F.when(F.col("typical") < lag("typical"), F.col("flow")).otherwise(0.0)
    df = df.withColumn("up", up).withColumn("down", down)
    df = df.withColumn("mfi", 100 - 100 / (1 + roll(F.sum, "up", n, 1) / (roll(F.sum, "down", n, 1) + TINY)))
    return signals(df, cross_up("mfi", 20), cross_up("mfi", 80))


@register("inverse_fisher_rsi")
def inverse_fisher_rsi(df, n: int = 14, smooth: int = 5):
    df = rsi_wilder(df, n).withColumn("v", (F.col("rsi") / 100 - 0.5) * 2).withColumn("sv", sma("v", smooth, 1))
    df = df.withColumn("ifr", (F.exp(2 * F.col("sv")) - 1) / (F.exp(2 * F.col("sv")) + 1))
    return signals(df, cross_up("ifr", -0.5), cross_up("ifr", 0.5))


def _recapture(df, ma: str, also: Column | None = None):
    entry = (F.col(C) > F.col(ma)) & (lag(C) <= lag(ma))
    return signals(df, entry if also is None else entry & also, F.col(C) < F.col(ma))


@register("ma_recapture")
def ma_recapture(df, n: int = 30):
    return _recapture(df.withColumn("ma", sma(C, n, 1)), "ma")


@register("ma_recapture_ema")
def ma_recapture_ema(df, n: int = 30):
    return _recapture(ewm(df, C, "ma", span=n), "ma")


@register("ma_recapture_rising")
def ma_recapture_rising(df, n: int = 30):
    df = df.withColumn("ma", sma(C, n, 1))
    return _recapture(df, "ma", rising("ma"))


@register("ma_recapture_dual")
def ma_recapture_dual(df, fast: int = 30, slow: int = 50):
    df = df.withColumn("ma", sma(C, fast, 1)).withColumn("slow", sma(C, slow, 1))
    return _recapture(df, "ma", F.col(C) > F.col("slow"))


@register("ma_recapture_low_vol")
def ma_recapture_low_vol(df, n: int = 30, vol: int = 20):
    df = df.withColumn("ma", sma(C, n, 1)).withColumn("r", change(C)).withColumn("vol", std("r", vol, 5)).withColumn("mid", quantile("vol", 0.5, 2 * vol, vol))
    return _recapture(df, "ma", F.col("vol") < F.col("mid"))


@register("ma_recapture_vol_expand")
def ma_recapture_vol_expand(df, n: int = 30, vol: int = 20):
    df = df.withColumn("ma", sma(C, n, 1)).withColumn("r", change(C)).withColumn("vol", std("r", vol, 5))
    return _recapture(df, "ma", F.col("vol") > lag("vol"))


@register("ma_recapture_high_volume")
def ma_recapture_high_volume(df, n: int = 30, vol: int = 20):
    df = df.withColumn("ma", sma(C, n, 1)).withColumn("mv", sma(V, vol, vol // 2))
    return _recapture(df, "ma", F.col(V) > F.col("mv"))


@register("ma_recapture_surge")
def ma_recapture_surge(df, n: int = 30, vol: int = 20, times: float = 1.5):
    df = df.withColumn("ma", sma(C, n, 1)).withColumn("mv", sma(V, vol, vol // 2))
    return _recapture(df, "ma", F.col(V) >= times * F.col("mv"))


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    df = df.withColumn("mid", sma(C, n)).withColumn("sd", std(C, n))
    df = df.withColumn("upper", F.col("mid") + k * F.col("sd")).withColumn("lower", F.col("mid") - k * F.col("sd"))
    return df.withColumn("width", F.when(F.col("mid") != 0, (F.col("upper") - F.col("lower")) / F.col("mid")))


@register("bollinger")
def bollinger_breakout(df, n: int = 20, k: float = 2.0):
    return signals(bollinger(df, n, k), F.col(C) > F.col("upper"), F.col(C) < F.col("mid"))


@register("bbwp")
def bbwp(df, n: int = 20, past: int = 50):
    df = bollinger(df, n).withColumn("bbwp", percent_rank("width", past, 5))
    return signals(df, (F.col(C) > F.col("upper")) & (F.col("bbwp") > 0.8), (F.col(C) < F.col("lower")) | (F.col("bbwp") < 0.2))


@register("mr_bounce")
def mr_bounce(df, n: int = 14):
    df = rsi_simple(df, n).withColumn("r5", change(C, 5))
    return signals(df, (F.col("rsi") < 30) & (F.col("r5") < -0.1), F.lit(False))


@register("obv")
def obv(df, n: int = 20):
    d = diff(C)
    df = df.withColumn("signed", F.when(d > 0, F.col(V)).when(d < 0, -F.col(V)).otherwise(0.0)).withColumn("obv", running(F.sum, "signed")).withColumn("ma", sma("obv", n, 1))
    return signals(df, (F.col("obv") > F.col("ma")) & rising("obv"), (F.col("obv") < F.col("ma")) & falling("obv"))


@register("efi")
def efi(df, n: int = 20):
    df = df.withColumn("force", F.coalesce(diff(C), F.lit(0.0)) * F.col(V)).withColumn("smooth", sma("force", n, 1))
    return signals(df, (F.col("force") > 0) & rising("smooth"), F.col("force") < 0)


@register("roc", "stc")
def roc(df, n: int = 10, up: float = 5.0, down: float = -5.0):
    df = df.withColumn("roc", 100 * change(C, n))
    return signals(df, F.col("roc") > up, F.col("roc") < down)


@register("trix")
def trix(df, n: int = 15):
    df = ewm(ewm(ewm(df, C, "e1", span=n), "e1", "e2", span=n), "e2", "e3", span=n).withColumn("trix", F.round(100 * change("e3"), 9))  # a flat series has no trend, whatever the last bits of its means
    return signals(df, (F.col("trix") > 0) & rising("trix"), F.col("trix") < 0)


@register("supertrend")
def supertrend(df, n: int = 10, k: float = 3.0):
    """The state is the last side passed, at first none; signals are its turns. The upper band lies below, as the rule has it."""
    df = _thrice(df, n)
    mid = (F.col(H) + F.col(L)) / 2
    df = df.withColumn("upper", mid - k * F.col("e3")).withColumn("lower", mid + k * F.col("e3"))
    side = F.when(F.col(C) > lag("upper"), 1).when(F.col(C) < lag("lower"), -1)
    df = df.withColumn("side", side).withColumn("state", F.coalesce(running(lambda c: F.last(c, ignorenulls=True), "side"), F.lit(0)))
    return signals(df, (F.col("state") == 1) & rising("state"), (F.col("state") == -1) & falling("state"))


def _thrice(df: DataFrame, n: int) -> DataFrame:
    """Adds e3, the exponential mean of the exponential mean of the close's."""
    return ewm(ewm(ewm(df, C, "e1", span=n), "e1", "e2", span=n), "e2", "e3", span=n)


@register("chandelier_flip")
def chandelier_flip(df, n: int = 22, k: float = 3.0, smooth: int = 10):
    df = _thrice(df, smooth)
    df = df.withColumn("up", flag(F.col(C) > roll(F.max, H, n, 1) - k * F.col("e3")))
    return signals(df, (lag("up") == 0) & (F.col("up") == 1), (lag("up") == 1) & (F.col("up") == 0))


@register("ichimoku")
def ichimoku(df, a: int = 9, b: int = 26, c: int = 52):
    mid = lambda n: (roll(F.max, H, n, 1) + roll(F.min, L, n, 1)) / 2
    df = df.withColumn("tenkan", mid(a)).withColumn("kijun", mid(b)).withColumn("span_b", mid(c)).withColumn("span_a", (F.col("tenkan") + F.col("kijun")) / 2)
    return signals(df, (F.col("tenkan") > F.col("kijun")) & (F.col(C) > F.greatest("span_a", "span_b")), F.col(C) < F.col("kijun"))


@register("liquid_cross")
def liquid_cross(df, fast: int = 20, slow: int = 50, q: float = 0.7, adv: int = 20):
    """A moving-average cross of symbols whose mean volume is over a quantile of the day's cross-section, in which a missing mean counts as 0."""
    df = df.withColumn("fast", sma(C, fast)).withColumn("slow", sma(C, slow)).withColumn("adv", sma(V, adv))
    floor = df.groupBy("ts").agg(F.percentile(F.coalesce("adv", F.lit(0.0)), F.lit(q)).alias("adv_floor"))
    df = df.join(floor, "ts")
    return signals(df, (F.col("fast") > F.col("slow")) & rising("fast") & (F.col("adv") > F.col("adv_floor")), F.col("fast") < F.col("slow"))


def macd(df: DataFrame, fast: int = 12, slow: int = 26, smooth: int = 9) -> DataFrame:
    df = ewm(ewm(df, C, "ef", span=fast), C, "es", span=slow).withColumn("macd", F.col("ef") - F.col("es"))
    return ewm(df, "macd", "macd_signal", span=smooth)


def _side(up: Column, down: Column) -> Column:
    return F.when(F.coalesce(up, F.lit(False)), 1).when(F.coalesce(down, F.lit(False)), -1).otherwise(0)


def _bars_of_symbol() -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy("symbol"))


def directional_rules(df: DataFrame) -> DataFrame:
    """Adds six rules of -1, 0 and 1: averages with volume, RSI with volume, volume breakout, channel, MACD, momentum.

    A rule is silent for symbols with fewer bars than its longest look back; where an average is still missing, the rules of
    two sides are on the lower one.
    """
    df = rsi_wilder(df).withColumn("s20", sma(C, 20)).withColumn("s50", sma(C, 50)).withColumn("v20", sma(V, 20)).withColumn("hi", roll(F.max, H, 20)).withColumn("lo", roll(F.min, L, 20)).withColumn("mom", change(C, 14)).withColumn("bars", _bars_of_symbol())
    df = macd(df)
    loud, louder = F.col(V) > 1.2 * F.col("v20"), F.col(V) > 1.5 * F.col("v20")
    over = F.coalesce(F.col("s20") > F.col("s50"), F.lit(False))
    above = F.coalesce(F.col("macd") > F.col("macd_signal"), F.lit(False))
    enough = lambda n, c: F.when(F.col("bars") >= n, c).otherwise(0)
    return (
        df.withColumn("sma_cross", enough(50, _side(over & loud, ~over & loud)))
        .withColumn("rsi_volume", enough(56, _side((F.col("rsi") > 55) & loud, (F.col("rsi") < 45) & loud)))
        .withColumn("volume_breakout", enough(20, _side((F.col(C) > lag("hi")) & louder, (F.col(C) < lag("lo")) & louder)))
        .withColumn("channel", enough(20, _side(F.col(C) > lag("hi"), F.col(C) < lag("lo"))))
        .withColumn("macd_side", enough(35, _side(above, ~above)))
        .withColumn("momentum", enough(14, _side(F.col("mom") > 0, F.col("mom") < 0)))
    )


def sticky(df: DataFrame, c: str, out: str) -> DataFrame:
    """The last side other than 0, from its bar on."""
    return df.withColumn(out, F.coalesce(running(lambda x: F.last(F.when(x != 0, x), ignorenulls=True), c), F.lit(0)))


def triple_up_share(df: DataFrame, a: int = 14, b: int = 28, c: int = 56) -> DataFrame:
    """held: 1 from the first bar on at which over half of the moves of each length rose."""
    df = df.withColumn("r", change(C))
    return sticky(df.withColumn("side", flag(reduce(lambda x, y: x & y, [up_share("r", n) > 0.5 for n in (a, b, c)]))), "side", "held")


def sticky_rules(df: DataFrame) -> DataFrame:
    """Adds six rules that hold their last side: averages crossing, triple up-share, channel, momentum, volume breakout, MACD.

    Only the channel has a side of -1; a rule is silent for symbols with fewer bars than its longest look back.
    """
    df = macd(triple_up_share(df.withColumn("bars", _bars_of_symbol()))).withColumns({"s20": sma(C, 20), "s50": sma(C, 50), "v20": sma(V, 20), "hi": roll(F.max, H, 20), "lo": roll(F.min, L, 20), "mom": change(C, 10)})
    over = df.withColumn("over", flag(F.col("s20") > F.col("s50")))
    sides = {
        "sma_cross": (50, F.when((F.col("over") == 1) & (lag("over") == 0), 1).otherwise(0)),
        "triple": (56, F.col("held")),
        "channel": (20, F.when(F.col(C) < lag("lo"), -1).when(F.col(C) > lag("hi"), 1).otherwise(0)),
        "momentum": (11, flag(F.col("mom") > 0)),
        "volume_breakout": (20, flag(F.col(V) > 1.5 * lag("v20"))),
        "macd": (35, flag(F.col("macd") > F.col("macd_signal"))),
    }
    df = over.withColumns({f"__{k}": F.when(F.col("bars") >= n, c).otherwise(0) for k, (n, c) in sides.items()})
    for k in sides:
        df = sticky(df, f"__{k}", k)
    return df.drop(*[f"__{k}" for k in sides])


def momentum_variants(df: DataFrame, n: int = 14, short: int = 10, long: int = 30, times: float = 1.2) -> DataFrame:
    """Adds six momentum sides: plain, flat when volatile, RSI-filtered, double, volume-confirmed, adaptive."""
    df = rsi_wilder(df).withColumn("r", change(C)).withColumn("mom", change(C, n)).withColumn("m1", change(C, short)).withColumn("m2", change(C, long)).withColumn("vol", std("r", 20)).withColumn("v20", sma(V, 20)).withColumn("am", F.abs("mom"))
    df = df.withColumn("vol100", sma("vol", 100)).withColumn("q", quantile("am", 0.4, 100))
    up, down = F.col("mom") > 0, F.col("mom") < 0
    return (
        df.withColumn("baseline", _side(up, down))
        .withColumn("vol_scaled", F.when(F.col("vol") > 2.5 * F.col("vol100"), 0).otherwise(_side(up, down)))
        .withColumn("rsi_filter", _side(up & (F.col("rsi") > 50), down & (F.col("rsi") < 50)))
        .withColumn("double", _side((F.col("m1") > 0) & (F.col("m2") > 0), (F.col("m1") < 0) & (F.col("m2") < 0)))
        .withColumn("volume_confirm", _side(up & (F.col(V) > times * F.col("v20")), down & (F.col(V) > times * F.col("v20"))))
        .withColumn("adaptive", _side(up & (F.col("am") > F.col("q")), down & (F.col("am") > F.col("q"))))
    )


@register("donchian_ensemble")
def donchian_ensemble(df, lengths: tuple[int, ...] = (20, 40, 60, 90), filter_sma: int | None = 50, filter_volume: bool = False):
    """A breakout of any of the channels, not under a mean of the close, or on no less volume than the bar before, if asked for."""
    for n in lengths:
        df = df.withColumn(f"t{n}", roll(F.max, H, n, 1)).withColumn(f"b{n}", roll(F.min, L, n, 1))
    entry = F.greatest(*[flag(F.col(C) > lag(f"t{n}")) for n in lengths]) == 1
    exit_ = F.greatest(*[flag(F.col(C) < lag(f"b{n}")) for n in lengths]) == 1
    if filter_sma:
        df = df.withColumn("ma", sma(C, filter_sma))
        entry = entry & (F.col(C) >= F.col("ma"))
    if filter_volume:
        entry = entry & (lag(V) > 0) & (F.col(V) >= lag(V))
    return signals(df, entry, exit_)


@register("slow_momentum")
def slow_momentum(df, n: int = 60):
    df = df.withColumn("mom", change(C, n))
    return signals(df, F.col("mom") > 0, F.col("mom") <= 0)


def strength(df: DataFrame, rule: str) -> DataFrame:
    """Adds a ranking strength: depth and turn of Williams %R, level and turn of REI, percent above the channel, or percent above the mean of span 30."""
    gained = lambda c, k: F.greatest(F.lit(0.0), k * F.coalesce(diff(c), F.lit(0.0)))
    if rule == "williams_r":
        return williams_r(df).withColumn("strength", gained("wr", 2.0) - F.col("wr"))
    if rule == "rei":
        return rei(df).withColumn("strength", F.col("rei") + gained("rei", 0.5))
    if rule == "donchian":
        top = lag("top")
        return donchian(df).withColumn("strength", 100 * (F.col(C) - top) / (top + TINY))
    return ewm(df, C, "ma", span=30).withColumn("strength", 100 * (F.col(C) - F.col("ma")) / (F.col("ma") + TINY))


def regime_switched(trend: DataFrame, chop: DataFrame, second: DataFrame, regime: DataFrame) -> DataFrame:
    """Signals of the regime's rule at each time; on choppy times when no symbol fires the second rule stands in."""
    key = ["symbol", "ts"]
    part = lambda df, n: df.select(*key, F.col("entry").alias(f"entry_{n}"), F.col("exit").alias(f"exit_{n}"))
    both = part(trend, "t").join(part(chop, "c"), key).join(part(second, "s"), key).join(regime.select("ts", "regime"), "ts")
    silent = both.groupBy("ts").agg((F.max("entry_c") == 0).alias("silent"))
    df = both.join(silent, "ts")
    pick = lambda c: F.when(F.col("regime") == "trend", F.col(f"{c}_t")).when(F.col("silent"), F.col(f"{c}_s")).otherwise(F.col(f"{c}_c"))
    return df.select(*key, pick("entry").alias("entry"), pick("exit").alias("exit"))


__all__ = ["RULES", "apply_rule", "register"]
