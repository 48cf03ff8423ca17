"""Technical indicators as window columns over laid out series.

An indicator tells how many rows it looks back and ahead and builds its columns on a
``Blocks`` layout.  ``add_indicators`` lays the bars out once, with the widest halo any
requested indicator needs, so all of them share one shuffle and mostly one sort.
Windows are full-frame only: null until enough rows exist.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.functions.expr import ratio
from loomcast.functions.series import Axis, Blocks, lay_out

Params = Mapping[str, float]


@dataclass(frozen=True)
class Indicator:
    """build(blocks, params, names) adds the columns ``names`` (one per output)."""

    defaults: dict
    outputs: tuple[str, ...]
    lookback: Callable[[Params], int]
    build: Callable[[Blocks, Params, tuple[str, ...]], Blocks]
    lookahead: Callable[[Params], int] = lambda p: 0
    #: needs totals from the start of the series: built after the halo is dropped
    running: bool = False
    #: built on EMAs
    recursive: bool = False


REGISTRY: dict[str, Indicator] = {}


def register(name, defaults: dict, outputs: tuple[str, ...], lookback, build, lookahead=None, running=False, recursive=False):
    REGISTRY[name] = Indicator(defaults, outputs, lookback, build, lookahead or (lambda p: 0), running, recursive)


# -- helpers -----------------------------------------------------------------

def span_alpha(n: float) -> float:
    return 2.0 / (n + 1.0)


def wma_column(b: Blocks, col: str, n: int) -> Column:
    """Linear weights 1..n, newest heaviest; null while the frame is short."""
    terms = [F.col(col) * n] + [b.lag(col, k) * (n - k) for k in range(1, n)]
    return reduce(lambda x, y: x + y, terms) / (n * (n + 1) / 2.0)


def rsi_columns(b: Blocks, col: str, n: int, name: str) -> Blocks:
    """Plain means of gains and losses (not Wilder's); no loss counts as 1e-9."""
    d, g, l = f"_{name}_d", f"_{name}_g", f"_{name}_l"
    b = b.add({d: F.col(col) - b.lag(col)})
    b = b.add({
        g: F.when(F.col(d).isNotNull(), F.greatest(d, F.lit(0.0))),
        l: F.when(F.col(d).isNotNull(), -F.least(d, F.lit(0.0))),
    })
    loss = b.roll(F.avg, l, n)
    rs = b.roll(F.avg, g, n) / F.when(loss == 0, 1e-9).otherwise(loss)
    return b.add({name: 100 - 100 / (1 + rs)}).drop(d, g, l)


def true_range(b: Blocks) -> Column:
    prev = b.lag("close")
    gap = F.greatest(F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    return F.greatest(F.col("high") - F.col("low"), gap)


def typical(prefix: str = "") -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def money_flow() -> Column:
    """Close location in the bar's range times volume; 0 for a bar without range."""
    span = F.col("high") - F.col("low")
    loc = (F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))
    return F.coalesce(F.try_divide(loc, span), F.lit(0.0)) * F.col("volume")


def _win(p: Params, key: str = "window") -> int:
    return int(p[key])


# -- moving averages ---------------------------------------------------------

def _sma(b, p, names):
    return b.add({names[0]: b.roll(F.avg, "close", _win(p))})


def _ema(b, p, names):
    return b.ema({names[0]: ("close", span_alpha(_win(p)))})


def _cascade(depth: int, combine: Callable[[list[Column], Params], Column]):
    """EMA of EMA of ...; all stages share their leaves, so one sort serves them all."""

    def build(b: Blocks, p: Params, names):
        a = span_alpha(_win(p))
        stages, src = [], "close"
        for i in range(depth):
            stages.append(f"_{names[0]}_{i}")
            b = b.ema({stages[-1]: (src, a)}, like="close")
            src = stages[-1]
        return b.add({names[0]: combine([F.col(s) for s in stages], p)}).drop(*stages)

    return build


def _t3(e: list[Column], p: Params) -> Column:
    v = float(p["volume_factor"])
    return (
        -(v**3) * e[5]
        + (3 * v**2 + 3 * v**3) * e[4]
        + (-6 * v**2 - 3 * v - 3 * v**3) * e[3]
        + (1 + 3 * v + v**3 + 3 * v**2) * e[2]
    )


def _wma(b, p, names):
    return b.add({names[0]: wma_column(b, "close", _win(p))})


def _hma(b, p, names):
    n = _win(p)
    raw = f"_{names[0]}_raw"
    b = b.add({raw: 2 * wma_column(b, "close", max(1, n // 2)) - wma_column(b, "close", n)})
    return b.add({names[0]: wma_column(b, raw, max(1, math.isqrt(n)))}).drop(raw)


register("SMA", {"window": 20}, ("",), lambda p: _win(p) - 1, _sma)
register("EMA", {"window": 20}, ("",), lambda p: 0, _ema, recursive=True)
register("WMA", {"window": 20}, ("",), lambda p: _win(p) - 1, _wma)
register("DEMA", {"window": 20}, ("",), lambda p: 0, _cascade(2, lambda e, p: 2 * e[0] - e[1]),
         recursive=True)
register("TEMA", {"window": 20}, ("",), lambda p: 0, _cascade(3, lambda e, p: 3 * e[0] - 3 * e[1] + e[2]),
         recursive=True)
register("HMA", {"window": 20}, ("",), lambda p: _win(p) + math.isqrt(_win(p)), _hma)
register("T3", {"window": 20, "volume_factor": 0.7}, ("",), lambda p: 0, _cascade(6, _t3), recursive=True)


# -- oscillators -------------------------------------------------------------

def _rsi(b, p, names):
    return rsi_columns(b, "close", _win(p), names[0])


def _smooth_k(b: Blocks, raw: str, p: Params, names) -> Blocks:
    b = b.add({names[0]: b.roll(F.avg, raw, _win(p, "smooth_k"))})
    return b.add({names[1]: b.roll(F.avg, names[0], _win(p, "d"))}).drop(raw)


def _stoch(b, p, names):
    n, raw = _win(p, "k"), f"_{names[0]}_raw"
    hi, lo = b.roll(F.max, "high", n), b.roll(F.min, "low", n)
    return _smooth_k(b.add({raw: 100 * F.try_divide(F.col("close") - lo, hi - lo)}), raw, p, names)


def _stochrsi(b, p, names):
    n, r, raw = _win(p, "window"), f"_{names[0]}_rsi", f"_{names[0]}_raw"
    b = rsi_columns(b, "close", n, r)
    hi, lo = b.roll(F.max, r, n), b.roll(F.min, r, n)
    b = b.add({raw: 100 * F.try_divide(F.col(r) - lo, hi - lo)}).drop(r)
    b = b.add({names[0]: b.roll(F.avg, raw, _win(p, "k"))})
    return b.add({names[1]: b.roll(F.avg, names[0], _win(p, "d"))}).drop(raw)


def _willr(b, p, names):
    n = _win(p)
    hi, lo = b.roll(F.max, "high", n), b.roll(F.min, "low", n)
    return b.add({names[0]: -100 * F.try_divide(hi - F.col("close"), hi - lo)})


def _cci(b, p, names):
    n, c = _win(p), float(p["constant"])
    tp, avg, dev = (f"_{names[0]}_{x}" for x in ("tp", "avg", "dev"))
    b = b.add({tp: typical()})
    b = b.add({avg: b.roll(F.avg, tp, n)})
    # mean distance to the frame's own mean: the frame is n values, never the series
    b = b.add({dev: F.aggregate(
        F.collect_list(tp).over(b.frame(n)), F.lit(0.0), lambda s, x: s + F.abs(x - F.col(avg))) / n})
    return b.add({names[0]: F.try_divide(F.col(tp) - F.col(avg), c * F.col(dev))}).drop(tp, avg, dev)


def _roc(b, p, names):
    return b.add({names[0]: 100 * (ratio("close", b.lag("close", _win(p))) - 1)})


def _mom(b, p, names):
    return b.add({names[0]: F.col("close") - b.lag("close", _win(p))})


register("RSI", {"window": 14}, ("",), lambda p: _win(p), _rsi)
register("STOCH", {"k": 14, "d": 3, "smooth_k": 3}, ("K", "D"),
         lambda p: _win(p, "k") + _win(p, "d") + _win(p, "smooth_k"), _stoch)
register("STOCHRSI", {"window": 14, "k": 3, "d": 3}, ("K", "D"),
         lambda p: 2 * _win(p) + _win(p, "k") + _win(p, "d"), _stochrsi)
register("WILLR", {"window": 14}, ("",), lambda p: _win(p) - 1, _willr)
register("CCI", {"window": 20, "constant": 0.015}, ("",), lambda p: _win(p) - 1, _cci)
register("ROC", {"window": 12}, ("",), lambda p: _win(p), _roc)
register("MOM", {"window": 10}, ("",), lambda p: _win(p), _mom)


# -- trend -------------------------------------------------------------------

def _macd(b, p, names):
    fast, slow, sig = (span_alpha(_win(p, k)) for k in ("fast", "slow", "signal"))
    f, s = f"_{names[0]}_f", f"_{names[0]}_s"
    b = b.ema({f: ("close", fast), s: ("close", slow)})
    b = b.add({names[0]: F.col(f) - F.col(s)}).drop(f, s)
    b = b.ema({names[1]: (names[0], sig)}, like="close")
    return b.add({names[2]: F.col(names[0]) - F.col(names[1])})


def _aroon(b, p, names):
    """Rows since the highest high / lowest low of the last n+1 rows (latest on ties)."""
    n, rn, full = _win(p), f"_{names[0]}_rn", f"_{names[0]}_full"
    b = b.add({rn: F.row_number().over(b.w)})
    frame = b.frame(n + 1)
    top = F.max(F.when(F.col("high").isNotNull(), F.struct("high", rn))).over(frame)[rn]
    low = F.min(F.when(F.col("low").isNotNull(), F.struct(F.col("low"), (-F.col(rn)).alias("r")))).over(frame)["r"]
    b = b.add({names[0]: top - F.col(rn), names[1]: -low - F.col(rn), full: F.count(F.lit(1)).over(frame) == n + 1})
    return b.add({c: F.when(F.col(full), 100 * (n + F.col(c)) / n) for c in names}).drop(rn, full)


def _directional(b: Blocks, n: int, name: str) -> tuple[Blocks, str, str, list[str]]:
    """Wilder-smoothed directional movement over true range; also smoothed TR."""
    pdm, mdm, tr = (f"_{name}_{x}" for x in ("pdm", "mdm", "tr"))
    up = F.col("high") - b.lag("high")
    down = b.lag("low") - F.col("low")
    b = b.add({
        pdm: F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)),
        mdm: F.when(up.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)),
        tr: F.when(up.isNotNull(), true_range(b)),
    })
    a = 1.0 / n
    sp, sm, st = (f"_{name}_{x}" for x in ("sp", "sm", "st"))
    b = b.ema({sp: (pdm, a), sm: (mdm, a), st: (tr, a)}, like=tr)
    pdi, mdi = f"_{name}_pdi", f"_{name}_mdi"
    b = b.add({pdi: 100 * F.try_divide(F.col(sp), F.col(st)), mdi: 100 * F.try_divide(F.col(sm), F.col(st))})
    return b, pdi, mdi, [pdm, mdm, tr, sp, sm, st, pdi, mdi]


def _dmi(b, p, names):
    b, pdi, mdi, temp = _directional(b, _win(p), names[0])
    return b.add({names[0]: F.col(pdi), names[1]: F.col(mdi)}).drop(*temp)


def _adx(b, p, names):
    n = _win(p)
    b, pdi, mdi, temp = _directional(b, n, names[0])
    dx = f"_{names[0]}_dx"
    spread = 100 * F.try_divide(F.abs(F.col(pdi) - F.col(mdi)), F.col(pdi) + F.col(mdi))
    b = b.add({dx: F.when(F.col(temp[2]).isNotNull(), F.coalesce(spread, F.lit(0.0)))})
    return b.ema({names[0]: (dx, 1.0 / n)}, like=temp[2]).drop(dx, *temp)


def _mid(b: Blocks, n: int) -> Column:
    return (b.roll(F.max, "high", n) + b.roll(F.min, "low", n)) / 2


def _ichimoku(b, p, names):
    t, k, s = _win(p, "tenkan"), _win(p, "kijun"), _win(p, "senkou")
    a, sb = f"_{names[0]}_a", f"_{names[0]}_b"
    b = b.add({names[0]: _mid(b, t), names[1]: _mid(b, k), sb: _mid(b, s)})
    b = b.add({a: (F.col(names[0]) + F.col(names[1])) / 2})
    return b.add({
        names[2]: b.lag(a, k), names[3]: b.lag(sb, k), names[4]: b.lead("close", k),
    }).drop(a, sb)


def _coppock(b, p, names):
    n, raw = _win(p), f"_{names[0]}_r"
    roc = [100 * (ratio("close", b.lag("close", _win(p, k))) - 1) for k in ("roc_long", "roc_short")]
    b = b.add({raw: roc[0] + roc[1]})
    return b.add({names[0]: wma_column(b, raw, n)}).drop(raw)


register("MACD", {"fast": 12, "slow": 26, "signal": 9}, ("", "SIGNAL", "HIST"),
         lambda p: 0, _macd,
         recursive=True)
register("AROON", {"window": 25}, ("UP", "DOWN"), lambda p: _win(p), _aroon)
register("ADX", {"window": 14}, ("",), lambda p: 1, _adx, recursive=True)
register("DMI", {"window": 14}, ("PLUS", "MINUS"), lambda p: 1, _dmi, recursive=True)
register("ICHIMOKU", {"tenkan": 9, "kijun": 26, "senkou": 52},
         ("TENKAN", "KIJUN", "SPAN_A", "SPAN_B", "CHIKOU"),
         lambda p: _win(p, "senkou") + _win(p, "kijun"), _ichimoku, lambda p: _win(p, "kijun"))
register("COPPOCK", {"window": 14, "roc_long": 14, "roc_short": 11}, ("",),
         lambda p: _win(p) + _win(p, "roc_long"), _coppock)


# -- volatility --------------------------------------------------------------

def _bbands(b, p, names):
    n, k = _win(p), float(p["std"])
    mid, sd = b.roll(F.avg, "close", n), b.roll(F.stddev_pop, "close", n)
    return b.add({names[0]: mid, names[1]: mid + k * sd, names[2]: mid - k * sd})


def _atr(b, p, names):
    tr = f"_{names[0]}_tr"
    return b.add({tr: true_range(b)}).ema({names[0]: (tr, 1.0 / _win(p))}).drop(tr)


register("BBANDS", {"window": 20, "std": 2}, ("MID", "UPPER", "LOWER"), lambda p: _win(p) - 1, _bbands)
register("ATR", {"window": 14}, ("",), lambda p: 1, _atr, recursive=True)
register("STD", {"window": 20}, ("",), lambda p: _win(p) - 1,
         lambda b, p, names: b.add({names[0]: b.roll(F.stddev_samp, "close", _win(p))}))
register("TR", {}, ("",), lambda p: 1, lambda b, p, names: b.add({names[0]: true_range(b)}))


# -- volume ------------------------------------------------------------------

def _cmf(b, p, names):
    n, mf = _win(p), f"_{names[0]}_mf"
    b = b.add({mf: money_flow()})
    return b.add({names[0]: F.try_divide(b.roll(F.sum, mf, n), b.roll(F.sum, "volume", n))}).drop(mf)


def _obv(b, p, names):
    return b.running_sum({names[0]: F.col("_obv_step")}).drop("_obv_step")


def _adl(b, p, names):
    return b.running_sum({names[0]: money_flow()})


def _vwap(b, p, names):
    """Running within each calendar day of a series."""
    v = f"_{names[0]}_v"
    b = b.add({"_day": F.to_date(b.axis.order)})
    b = b.running_sum({names[0]: typical() * F.col("volume"), v: F.col("volume")}, within=("_day",))
    return b.add({names[0]: F.try_divide(F.col(names[0]), F.col(v))}).drop(v, "_day")


def _uo(b, p, names):
    bp, tr = f"_{names[0]}_bp", f"_{names[0]}_tr"
    prev = b.lag("close")
    b = b.add({
        bp: F.when(prev.isNotNull(), F.col("close") - F.least(F.col("low"), prev)),
        tr: F.when(prev.isNotNull(), true_range(b)),
    })
    def part(k):
        return F.try_divide(b.roll(F.sum, bp, _win(p, k)), b.roll(F.sum, tr, _win(p, k)))

    score = 100 * (4 * part("short") + 2 * part("medium") + part("long")) / 7
    return b.add({names[0]: score}).drop(bp, tr)


def _donchian(b, p, names):
    n = _win(p)
    hi, lo = b.roll(F.max, "high", n), b.roll(F.min, "low", n)
    return b.add({names[0]: hi, names[1]: lo, names[2]: (hi + lo) / 2})


register("OBV", {}, ("",), lambda p: 1, _obv, running=True)
register("CMF", {"window": 20}, ("",), lambda p: _win(p) - 1, _cmf)
register("ADL", {}, ("",), lambda p: 0, _adl, running=True)
register("VWAP", {}, ("",), lambda p: 0, _vwap, running=True)
register("UO", {"short": 7, "medium": 14, "long": 28}, ("",), lambda p: _win(p, "long"), _uo)
register("DONCHIAN", {"window": 20}, ("UPPER", "LOWER", "MID"), lambda p: _win(p) - 1, _donchian)


# -- entry points ------------------------------------------------------------

def column_names(name: str, params: Mapping) -> tuple[str, ...]:
    """NAME_<params>[_OUTPUT]: SMA_5, STOCH_14_3_3_K, MACD_12_26_9, BBANDS_20_STD3_UPPER."""
    ind = REGISTRY[name]
    full = {**ind.defaults, **params}
    quiet = ("constant", "volume_factor", "std", "roc_long", "roc_short")  # named only where they differ from the default
    parts = [f"{v:g}" for k, v in full.items() if k not in quiet]
    parts += [f"{k.replace('_', '').upper()}{full[k]:g}" for k in quiet if k in full and full[k] != ind.defaults[k]]
    base = "_".join([name, *[p.replace(".", "p") for p in parts]])
    return tuple(f"{base}_{o}" if o else base for o in ind.outputs)


def resolve(cfg: Iterable[Mapping]) -> list[tuple[Indicator, dict, tuple[str, ...]]]:
    """Config entries {name, ...params} to indicators; names are case-blind, the same
    columns are computed once, an unknown name is an error."""
    out, seen = [], set()
    for entry in cfg:
        name = str(entry["name"]).upper()
        if name not in REGISTRY:
            raise ValueError(f"unsupported indicator '{name}'")
        given = {k: v for k, v in entry.items() if k != "name"}
        unknown = set(given) - set(REGISTRY[name].defaults)
        if unknown:
            raise ValueError(f"unknown parameters {sorted(unknown)} for indicator '{name}'")
        names = column_names(name, given)
        if names not in seen:
            seen.add(names)
            out.append((REGISTRY[name], {**REGISTRY[name].defaults, **given}, names))
    return out


def add_indicators(bars: DataFrame, cfg: Iterable[Mapping], axis: Axis = Axis()) -> DataFrame:
    """Bars with the columns of all requested indicators: one layout, one shuffle."""
    todo = resolve(cfg)
    back = max([ind.lookback(p) for ind, p, _ in todo], default=0)
    ahead = max([ind.lookahead(p) for ind, p, _ in todo], default=0)
    b = lay_out(bars, axis, back, ahead)
    # recurrences sort by leaf: the plain windows go first and share the first sort
    for ind, p, names in sorted(todo, key=lambda t: t[0].recursive):
        if not ind.running:
            b = ind.build(b, p, names)
    running = [t for t in todo if t[0].running]
    if any(ind is REGISTRY["OBV"] for ind, _, _ in running):
        step = F.signum(F.col("close") - b.lag("close")) * F.col("volume")
        b = b.add({"_obv_step": F.coalesce(step, F.lit(0.0))})
    b = b.own()
    for ind, p, names in running:
        b = ind.build(b, p, names)
    return b.rows()


def model_frame(bars: DataFrame, cfg: Iterable[Mapping], axis: Axis = Axis()) -> DataFrame:
    """Indicator columns as the regression step wants them: a window of 5 unless given,
    SMA(5) always present, rows with any null dropped."""
    simple = [{"name": c["name"], "window": int(c.get("window", 5))} for c in cfg]
    for c in simple:
        if str(c["name"]).upper() not in ("SMA", "EMA", "RSI"):
            raise ValueError(f"unsupported indicator '{str(c['name']).upper()}'")
    return add_indicators(bars, [*simple, {"name": "SMA", "window": 5}], axis).dropna("any")
