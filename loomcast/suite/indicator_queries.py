"""Indicator queries and their SQL twins."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from loomcast.functions.series import DAILY, HOURLY, lay_out
from loomcast.operators.features import exponential_smoothing
from loomcast.operators.indicators import add_indicators
from loomcast.suite.registry import query
from loomcast.suite.views import ctes

W = "PARTITION BY symbol ORDER BY ts"


def fr(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, col: str, n: int) -> str:
    return f"CASE WHEN count({col}) OVER {fr(n)} >= {n} THEN {agg}({col}) OVER {fr(n)} END"


def lag(col: str, k: int = 1) -> str:
    return f"lag({col}, {k}) OVER ({W})"


def wma(col: str, n: int) -> str:
    terms = " + ".join(
        f"{n - k} * " + (col if k == 0 else lag(col, k)) for k in range(n)
    )
    return f"({terms}) / {n * (n + 1) / 2.0}"


def over(src: str, *cols: str) -> str:
    """SELECT *, cols FROM (src)."""
    return f"SELECT *, {', '.join(cols)} FROM ({src}) s"


def _run(cfg, rename, hourly, t):
    bars, axis = (t.bars_hourly(), HOURLY) if hourly else (t.bars_daily(), DAILY)
    df = add_indicators(bars, [cfg], axis)
    return df.withColumnsRenamed(rename)


def indicator(name: str, cfg: dict, out: dict[str, tuple[str, int]], body: str, hourly: bool = False, recursive: bool = False):
    """Register ind_<name>; ``out``: column -> (engine column, decimals)."""
    rename = {src: c for c, (src, _) in out.items()}
    view = ("hourly_rn" if recursive else "bars_hourly") if hourly else "bars_daily"
    sql = f"{ctes(view, recursive=recursive)}{',' if recursive else ''}\n{body}"
    query(f"ind_{name}", ["symbol", "ts"], {c: d for c, (_, d) in out.items()}, sql)(
        partial(_run, cfg, rename, hourly)
    )


B = "SELECT * FROM bars_daily"

indicator("sma", {"name": "SMA"}, {"sma": ("SMA_20", 4)}, over(B, f"{full('avg', 'close', 20)} AS sma"))

_RSI = lambda n, src: over(
    over(over(src, f"close - {lag('close')} AS d"),
         "CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS g", "CASE WHEN d IS NOT NULL THEN -least(d, 0) END AS l"),
    f"{full('avg', 'g', n)} AS ag", f"{full('avg', 'l', n)} AS al")
RSI14 = over(_RSI(14, B), "100 - 100 / (1 + ag / CASE WHEN al = 0 THEN 1e-9 ELSE al END) AS rsi")
indicator("rsi", {"name": "RSI"}, {"rsi": ("RSI_14", 6)}, RSI14)

indicator("wma", {"name": "WMA"}, {"wma": ("WMA_20", 4)}, over(B, f"{wma('close', 20)} AS wma"))
indicator("hma", {"name": "HMA"}, {"hma": ("HMA_20", 4)},
          over(over(B, f"2 * {wma('close', 10)} - {wma('close', 20)} AS raw"), f"{wma('raw', 4)} AS hma"))
_K = over(over(B, f"{full('max', 'high', 14)} AS hh", f"{full('min', 'low', 14)} AS ll"),
          "CASE WHEN hh <> ll THEN 100 * ((close - ll) / (hh - ll)) END AS raw")
indicator("stoch", {"name": "STOCH"}, {"k": ("STOCH_14_3_3_K", 6), "d": ("STOCH_14_3_3_D", 6)},
          over(over(_K, f"{full('avg', 'raw', 3)} AS k"), f"{full('avg', 'k', 3)} AS d"))
_SR = over(over(RSI14, f"{full('max', 'rsi', 14)} AS hh", f"{full('min', 'rsi', 14)} AS ll"),
           "CASE WHEN hh <> ll THEN 100 * ((rsi - ll) / (hh - ll)) END AS raw")
indicator("stochrsi", {"name": "STOCHRSI"}, {"sk": ("STOCHRSI_14_3_3_K", 5), "sd": ("STOCHRSI_14_3_3_D", 5)},
          over(over(_SR, f"{full('avg', 'raw', 3)} AS sk"), f"{full('avg', 'sk', 3)} AS sd"))
indicator("willr", {"name": "WILLR"}, {"willr": ("WILLR_14", 6)},
          over(over(B, f"{full('max', 'high', 14)} AS hh", f"{full('min', 'low', 14)} AS ll"),
               "CASE WHEN hh <> ll THEN -100 * ((hh - close) / (hh - ll)) END AS willr"))
_TP = over(over(B, "(high + low + close) / 3 AS tp"), f"{full('avg', 'tp', 20)} AS a", f"list(tp) OVER {fr(20)} AS arr")
indicator("cci", {"name": "CCI"}, {"cci": ("CCI_20", 4)},
          over(_TP, "(tp - a) / (0.015 * list_sum(list_transform(arr, lambda x: abs(x - a))) / 20) AS cci"))
indicator("roc", {"name": "ROC"}, {"roc": ("ROC_12", 6)}, over(B, f"100 * (close / {lag('close', 12)} - 1) AS roc"))
indicator("mom", {"name": "MOM"}, {"mom": ("MOM_10", 4)}, over(B, f"close - {lag('close', 10)} AS mom"))
indicator("aroon", {"name": "AROON"}, {"up": ("AROON_25_UP", 6), "down": ("AROON_25_DOWN", 6)},
          over(over(over(B, f"row_number() OVER ({W}) AS rn"), f"count(*) OVER {fr(26)} AS n",
                    f"max_by(rn, high) OVER {fr(26)} AS rh", f"min_by(rn, low) OVER {fr(26)} AS rl"),
               "CASE WHEN n = 26 THEN 100 * (25 - (rn - rh)) / 25.0 END AS up",
               "CASE WHEN n = 26 THEN 100 * (25 - (rn - rl)) / 25.0 END AS down"))


def _mid(n: int) -> str:
    return f"({full('max', 'high', n)} + {full('min', 'low', n)}) / 2"


_ICH = over(over(B, f"{_mid(9)} AS tenkan", f"{_mid(26)} AS kijun", f"{_mid(52)} AS sb"), "(tenkan + kijun) / 2 AS sa")
indicator("ichimoku", {"name": "ICHIMOKU"},
          {o.lower(): (f"ICHIMOKU_9_26_52_{o}", 4) for o in ("TENKAN", "KIJUN", "SPAN_A", "SPAN_B", "CHIKOU")},
          over(_ICH, f"{lag('sa', 26)} AS span_a", f"{lag('sb', 26)} AS span_b",
               f"lead(close, 26) OVER ({W}) AS chikou"))
indicator("coppock", {"name": "COPPOCK"}, {"coppock": ("COPPOCK_14", 5)},
          over(over(B, f"100 * (close / {lag('close', 14)} - 1) + 100 * (close / {lag('close', 11)} - 1) AS r"),
               f"{wma('r', 14)} AS coppock"))
indicator("bbands", {"name": "BBANDS"}, {k: (f"BBANDS_20_{k.upper()}", 4) for k in ("mid", "upper", "lower")},
          over(over(B, f"{full('avg', 'close', 20)} AS mid", f"{full('stddev_pop', 'close', 20)} AS sd"),
               "mid + 2 * sd AS upper", "mid - 2 * sd AS lower"))
indicator("std", {"name": "STD"}, {"std": ("STD_20", 4)}, over(B, f"{full('stddev_samp', 'close', 20)} AS std"))
TR = "greatest(high - low, greatest(abs(high - pc), abs(low - pc)))"
indicator("tr", {"name": "TR"}, {"tr": ("TR", 4)}, over(over(B, f"{lag('close')} AS pc"), f"{TR} AS tr"))
RUN = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
indicator("obv", {"name": "OBV"}, {"obv": ("OBV", 4)},
          over(over(B, f"coalesce(sign(close - {lag('close')}) * volume, 0) AS s"), f"sum(s) OVER {RUN} AS obv"))
_MF = over(B, "CASE WHEN high <> low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END AS mf")
indicator("cmf", {"name": "CMF"}, {"cmf": ("CMF_20", 6)},
          over(_MF, f"{full('sum', 'mf', 20)} / {full('sum', 'volume', 20)} AS cmf"))
indicator("adl", {"name": "ADL"}, {"adl": ("ADL", 5)}, over(_MF, f"sum(mf) OVER {RUN} AS adl"))
_DAYRUN = "(PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
indicator("vwap", {"name": "VWAP"}, {"vwap": ("VWAP", 9)},
          over("SELECT * FROM bars_hourly",
               f"sum((high + low + close) / 3 * volume) OVER {_DAYRUN} / sum(volume) OVER {_DAYRUN} AS vwap"), hourly=True)
_UO = over(over(B, f"{lag('close')} AS pc"), "CASE WHEN pc IS NOT NULL THEN close - least(low, pc) END AS bp",
           f"CASE WHEN pc IS NOT NULL THEN {TR} END AS tr")


def _uo(n: int) -> str:
    return f"({full('sum', 'bp', n)}) / nullif({full('sum', 'tr', n)}, 0)"


indicator("uo", {"name": "UO"}, {"uo": ("UO_7_14_28", 6)},
          over(_UO, f"100 * (4 * ({_uo(7)}) + 2 * ({_uo(14)}) + ({_uo(28)})) / 7 AS uo"))
indicator("donchian", {"name": "DONCHIAN"}, {k: (f"DONCHIAN_20_{k.upper()}", 4) for k in ("upper", "lower", "mid")},
          over(over(B, f"{full('max', 'high', 20)} AS upper", f"{full('min', 'low', 20)} AS lower"),
               "(upper + lower) / 2 AS mid"))


# -- recurrences: recursive SQL as the twin ----------------------------------------

def recur(states: dict[str, tuple[str, str]], final: str, src: str = "hourly_rn", null_first: bool = False) -> str:
    """A recursive CTE: states name -> (value at the first row, value from p.<state> and b)."""
    first = ", ".join(f"{init} AS {n}" for n, (init, _) in states.items())
    nxt = ", ".join(expr for _, expr in states.values())
    return f"""r AS (
  SELECT b.symbol, b.ts, b.rn, {first} FROM {src} b WHERE rn = 1
  UNION ALL
  SELECT b.symbol, b.ts, b.rn, {nxt} FROM r p JOIN {src} b ON b.symbol = p.symbol AND b.rn = p.rn + 1
) SELECT symbol, ts, {final} FROM r"""


def _e(a: float, x: str, p: str) -> str:
    return f"({a!r} * ({x}) + {1 - a!r} * ({p}))"


def cascade(n: int, depth: int) -> dict[str, tuple[str, str]]:
    a, out, x = 2.0 / (n + 1), {}, "b.close"
    for i in range(1, depth + 1):
        x = _e(a, x, f"p.e{i}")
        out[f"e{i}"] = ("b.close", x)
    return out


def hourly(name, cfg, out, states, final):
    indicator(name, cfg, out, recur(states, final), hourly=True, recursive=True)


hourly("ema", {"name": "EMA"}, {"ema": ("EMA_20", 4)}, cascade(20, 1), "e1 AS ema")
hourly("dema", {"name": "DEMA"}, {"dema": ("DEMA_20", 4)}, cascade(20, 2), "2 * e1 - e2 AS dema")
hourly("tema", {"name": "TEMA"}, {"tema": ("TEMA_20", 4)}, cascade(20, 3), "3 * e1 - 3 * e2 + e3 AS tema")
hourly("t3", {"name": "T3"}, {"t3": ("T3_20", 4)}, cascade(20, 6),
       "-0.343 * e6 + (3 * 0.49 + 3 * 0.343) * e5 + (-6 * 0.49 - 3 * 0.7 - 3 * 0.343) * e4"
       " + (1 + 3 * 0.7 + 0.343 + 3 * 0.49) * e3 AS t3")
_f, _s = _e(2 / 13, "b.close", "p.f"), _e(2 / 27, "b.close", "p.s")
hourly("macd", {"name": "MACD"},
       {"macd": ("MACD_12_26_9", 4), "sig": ("MACD_12_26_9_SIGNAL", 4), "hist": ("MACD_12_26_9_HIST", 4)},
       {"f": ("b.close", _f), "s": ("b.close", _s), "g": ("0.0::DOUBLE", _e(0.2, f"{_f} - {_s}", "p.g"))},
       "f - s AS macd, g AS sig, (f - s) - g AS hist")
_PREV = {"ph": ("b.high", "b.high"), "pl": ("b.low", "b.low"), "pc": ("b.close", "b.close")}
_TRB = "greatest(b.high - b.low, greatest(abs(b.high - p.pc), abs(b.low - p.pc)))"
# the first row has no previous close: its range is high - low
_ATR = {**_PREV, "a": ("b.high - b.low", _e(1 / 14, _TRB, "p.a"))}
hourly("atr", {"name": "ATR"}, {"atr": ("ATR_14", 4)}, _ATR, "a AS atr")
_UP, _DN = "(b.high - p.ph)", "(p.pl - b.low)"
_PDM = f"CASE WHEN {_UP} > {_DN} AND {_UP} > 0 THEN {_UP} ELSE 0.0 END"
_MDM = f"CASE WHEN {_DN} > {_UP} AND {_DN} > 0 THEN {_DN} ELSE 0.0 END"


def _wilder(x: str, p: str) -> str:
    return f"CASE WHEN {p} IS NULL THEN {x} ELSE {_e(1 / 14, x, p)} END"


_NULL = "CAST(NULL AS DOUBLE)"
_DM = {**_PREV, "sp": (_NULL, _wilder(_PDM, "p.sp")), "sm": (_NULL, _wilder(_MDM, "p.sm")),
       "st": (_NULL, _wilder(_TRB, "p.st"))}
_PDI, _MDI = "100 * sp / nullif(st, 0)", "100 * sm / nullif(st, 0)"
hourly("dmi", {"name": "DMI"}, {"plus": ("DMI_14_PLUS", 4), "minus": ("DMI_14_MINUS", 4)}, _DM,
       f"{_PDI} AS plus, {_MDI} AS minus")
_ADX = f"""{recur(_DM, f'rn, {_PDI} AS pdi, {_MDI} AS mdi')[:-len(' FROM r')]} FROM r"""
indicator(
    "adx", {"name": "ADX"}, {"adx": ("ADX_14", 4)},
    _ADX.replace("SELECT symbol, ts, rn,", ", dm AS MATERIALIZED (SELECT symbol, ts, rn,", 1).replace(") , dm", "), dm", 1)
    + """), dx AS MATERIALIZED (SELECT symbol, ts, rn,
      CASE WHEN rn > 1 THEN coalesce(100 * abs(pdi - mdi) / nullif(pdi + mdi, 0), 0) END AS dx
      FROM dm),
    x AS (SELECT symbol, ts, rn, dx AS adx FROM dx WHERE rn = 1
      UNION ALL SELECT d.symbol, d.ts, d.rn, """ + _wilder("d.dx", "p.adx").replace("b.", "d.") + """
      FROM x p JOIN dx d ON d.symbol = p.symbol AND d.rn = p.rn + 1)
    SELECT symbol, ts, adx FROM x""",
    hourly=True, recursive=True,
)

query("exp_smooth", ["symbol", "ts"], {"smooth": 4},
      f"{ctes('hourly_rn', recursive=True)},\n" + recur({"e": ("b.close", _e(0.2, "b.close", "p.e"))}, "e AS smooth"))(
    lambda t: exponential_smoothing(t.bars_hourly(), 0.2, False, HOURLY))
query("exp_smooth_adjusted", ["symbol", "ts"], {"smooth": 4},
      f"{ctes('hourly_rn', recursive=True)},\n" + recur(
          {"num": ("b.close", "b.close + 0.8 * p.num"), "den": ("1.0::DOUBLE", "1.0 + 0.8 * p.den")}, "num / den AS smooth"))(
    lambda t: exponential_smoothing(t.bars_hourly(), 0.2, True, HOURLY))

_VALUES = """nn AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn
  FROM bars_gappy WHERE close IS NOT NULL)"""
_CARRIED = """SELECT g.symbol, g.ts, last_value({} IGNORE NULLS) OVER (
  PARTITION BY g.symbol ORDER BY g.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS smooth
FROM bars_gappy g LEFT JOIN e ON e.symbol = g.symbol AND e.ts = g.ts"""
query("exp_smooth_gappy", ["symbol", "ts"], {"smooth": 4}, f"""{ctes('bars_gappy', recursive=True)}, {_VALUES},
e AS (SELECT symbol, ts, rn, close AS e FROM nn WHERE rn = 1 UNION ALL
  SELECT n.symbol, n.ts, n.rn, 0.2 * n.close + 0.8 * e.e FROM e JOIN nn n ON n.symbol = e.symbol AND n.rn = e.rn + 1)
{_CARRIED.format('e.e')}""")(lambda t: exponential_smoothing(t.bars_gappy(), 0.2, False, DAILY))
query("exp_smooth_adjusted_gappy", ["symbol", "ts"], {"smooth": 4}, f"""{ctes('bars_gappy', recursive=True)}, {_VALUES},
e AS (SELECT symbol, ts, rn, close AS num, 1.0::DOUBLE AS den FROM nn WHERE rn = 1 UNION ALL
  SELECT n.symbol, n.ts, n.rn, n.close + 0.8 * e.num, 1.0 + 0.8 * e.den FROM e JOIN nn n ON n.symbol = e.symbol AND n.rn = e.rn + 1)
{_CARRIED.format('e.num / e.den')}""")(lambda t: exponential_smoothing(t.bars_gappy(), 0.2, True, DAILY))
query("ind_ema_gappy", ["symbol", "ts"], {"ema": 4}, f"""{ctes('bars_gappy', recursive=True)}, {_VALUES},
e AS (SELECT symbol, ts, rn, close AS e FROM nn WHERE rn = 1 UNION ALL
  SELECT n.symbol, n.ts, n.rn, 0.2 * n.close + 0.8 * e.e FROM e JOIN nn n ON n.symbol = e.symbol AND n.rn = e.rn + 1)
{_CARRIED.format('e.e').replace('smooth', 'ema')}""")(
    lambda t: add_indicators(t.bars_gappy(), [{"name": "EMA", "window": 9}], DAILY).withColumnRenamed("EMA_9", "ema"))
query("ind_macd_gappy", ["symbol", "ts"], {"macd": 4, "sig": 4}, f"""{ctes('bars_gappy', recursive=True)}, {_VALUES},
e AS (SELECT symbol, ts, rn, close AS f, close AS s, 0.0::DOUBLE AS g FROM nn WHERE rn = 1 UNION ALL
  SELECT b.symbol, b.ts, b.rn, {_f}, {_s}, {_e(0.2, f"{_f} - {_s}", "p.g")} FROM e p JOIN nn b ON b.symbol = p.symbol AND b.rn = p.rn + 1)
{_CARRIED.format('e.f - e.s').replace('smooth', 'macd').replace('FROM bars_gappy', """, last_value(e.g IGNORE NULLS) OVER (
  PARTITION BY g.symbol ORDER BY g.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sig FROM bars_gappy""")}""")(
    lambda t: add_indicators(t.bars_gappy(), [{"name": "MACD"}], DAILY).withColumnsRenamed(
        {"MACD_12_26_9": "macd", "MACD_12_26_9_SIGNAL": "sig"}))


def _holed(t):
    """Every 7th bar of a series is missing altogether."""
    cols = ("high", "low", "close")
    df = lay_out(t.bars_daily().select("symbol", "ts", *cols), DAILY).number("rn").rows()
    return df.withColumns({c: F.when(F.col("rn") % 7 != 0, F.col(c)) for c in cols}).drop("rn")


query("ind_adx_gappy", ["symbol", "ts"], {"adx": 4}, f"""{ctes('bars_daily', recursive=True)},
g AS (SELECT symbol, ts, {', '.join(f'CASE WHEN rn % 7 <> 0 THEN {c} END AS {c}' for c in ('high', 'low', 'close'))}
  FROM (SELECT *, row_number() OVER ({W}) AS rn FROM bars_daily) n),
m AS MATERIALIZED (SELECT symbol, ts, row_number() OVER ({W}) AS rn, {TR} AS tr,
    CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0.0 END AS pdm,
    CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0.0 END AS mdm
  FROM (SELECT *, {lag('high')} AS ph, {lag('low')} AS pl, {lag('close')} AS pc FROM g) l WHERE high IS NOT NULL AND ph IS NOT NULL),
s AS (SELECT symbol, ts, rn, pdm AS sp, mdm AS sm, tr AS st FROM m WHERE rn = 1 UNION ALL
  SELECT b.symbol, b.ts, b.rn, {_e(1 / 14, 'b.pdm', 'p.sp')}, {_e(1 / 14, 'b.mdm', 'p.sm')}, {_e(1 / 14, 'b.tr', 'p.st')}
  FROM s p JOIN m b ON b.symbol = p.symbol AND b.rn = p.rn + 1),
d AS MATERIALIZED (SELECT symbol, ts, rn, coalesce(100 * abs(pdi - mdi) / nullif(pdi + mdi, 0), 0) AS dx
  FROM (SELECT symbol, ts, rn, {_PDI} AS pdi, {_MDI} AS mdi FROM s) i),
x AS (SELECT symbol, ts, rn, dx AS adx FROM d WHERE rn = 1 UNION ALL
  SELECT b.symbol, b.ts, b.rn, {_e(1 / 14, 'b.dx', 'p.adx')} FROM x p JOIN d b ON b.symbol = p.symbol AND b.rn = p.rn + 1)
SELECT g.symbol, g.ts, last_value(x.adx IGNORE NULLS) OVER (
  PARTITION BY g.symbol ORDER BY g.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adx
FROM g LEFT JOIN x ON x.symbol = g.symbol AND x.ts = g.ts""")(
    lambda t: add_indicators(_holed(t), [{"name": "ADX"}], DAILY).withColumnRenamed("ADX_14", "adx"))
query("ind_bbands_two_widths", ["symbol", "ts"], {"two": 4, "three": 4}, f"{ctes('bars_daily')} " + over(
    over("SELECT symbol, ts, close FROM bars_daily", f"{full('avg', 'close', 20)} AS mid", f"{full('stddev_pop', 'close', 20)} AS sd"),
    "mid + 2 * sd AS two", "mid + 3 * sd AS three"))(
    lambda t: add_indicators(t.bars_daily(), [{"name": "BBANDS"}, {"name": "BBANDS", "std": 3}], DAILY).withColumnsRenamed(
        {"BBANDS_20_UPPER": "two", "BBANDS_20_STD3_UPPER": "three"}))

# -- many series -------------------------------------------------------------------

WIDE = "SELECT symbol, ts, high, low, close FROM bars_wide"
query("indicators_wide", ["symbol", "ts"], {"sma": 4, "rsi": 6, "upper": 4, "k": 5}, f"""{ctes('bars_wide')}
SELECT symbol, ts, sma, rsi, sma + 2 * sd AS upper, {full('avg', 'raw', 3)} AS k FROM (
  SELECT *, 100 - 100 / (1 + ag / CASE WHEN al = 0 THEN 1e-9 ELSE al END) AS rsi,
    CASE WHEN hh <> ll THEN 100 * ((close - ll) / (hh - ll)) END AS raw FROM (
  {over(over(over(WIDE, f"close - {lag('close')} AS d"), 'CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS g',
        'CASE WHEN d IS NOT NULL THEN -least(d, 0) END AS l'),
        f"{full('avg', 'g', 14)} AS ag", f"{full('avg', 'l', 14)} AS al", f"{full('avg', 'close', 20)} AS sma",
        f"{full('stddev_pop', 'close', 20)} AS sd", f"{full('max', 'high', 14)} AS hh", f"{full('min', 'low', 14)} AS ll")}) y) z""")(
    lambda t: add_indicators(t.bars_wide(), [{"name": n} for n in ("SMA", "RSI", "BBANDS", "STOCH")], DAILY).withColumnsRenamed(
        {"SMA_20": "sma", "RSI_14": "rsi", "BBANDS_20_UPPER": "upper", "STOCH_14_3_3_K": "k"}))
# the recursion of all series advances together, one row of each per step
query("ema_wide", ["symbol", "ts"], {"ema": 3}, f"""{ctes('bars_wide', recursive=True)},
wide_rn AS MATERIALIZED (SELECT symbol, ts, close, row_number() OVER ({W}) AS rn FROM bars_wide),
{recur(cascade(20, 1), 'e1 AS ema', 'wide_rn')}""")(
    lambda t: add_indicators(t.bars_wide(), [{"name": "EMA"}], DAILY).withColumnRenamed("EMA_20", "ema"))
