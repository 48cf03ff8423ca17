"""Bars, features, splits, calendars and preprocessing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Observation
from pyspark.sql import functions as F

from loomcast.functions.expr import business_calendar, next_weekday, with_next_open
from loomcast.functions.series import DAILY
from loomcast.operators import features as ft
from loomcast.operators import preprocess as pp
from loomcast.operators.indicators import model_frame
from loomcast.plans.config import select_by_prefix
from loomcast.session import scratch
from loomcast.sources import bars as bs
from loomcast.suite.indicator_queries import W, full, lag, over
from loomcast.suite.registry import query
from loomcast.suite.views import ctes

DAILY_SQL = ctes("bars_daily")
GAPPY = ctes("bars_gappy")

# -- bars ----------------------------------------------------------------------

for _name, _freq, _unit in (("week", "1wk", "week"), ("month", "1mo", "month")):
    query(f"bars_resample_{_name}", ["symbol", "ts"], {"open": 2, "high": 2, "low": 2, "close": 2, "volume": 1}, f"""{DAILY_SQL}
SELECT symbol, CAST(date_trunc('{_unit}', ts) AS DATE) AS ts, min_by(open, b.ts) AS open, max(high) AS high,
       min(low) AS low, max_by(close, b.ts) AS close, sum(volume) AS volume
FROM bars_daily b GROUP BY symbol, CAST(date_trunc('{_unit}', b.ts) AS DATE)""")(
        lambda t, f=_freq: bs.resample(t.bars_daily(), f))

query("bars_wide_range", ["symbol", "ts"], {"close": 2, "volume": 1}, f"""{ctes('bars_wide')}
SELECT symbol, ts, close, volume FROM bars_wide WHERE ts >= DATE '1997-01-01' AND ts < DATE '1998-01-01'""")(
    lambda t: bs.normalise(t.bars_wide()).where(
        (F.col("ts") >= F.lit(dt.date(1997, 1, 1))) & (F.col("ts") < F.lit(dt.date(1998, 1, 1)))))

query("bars_written", ["symbol", "ts"], {"open": 2, "close": 2}, f"{ctes('bars_wide')} SELECT symbol, ts, open, close FROM bars_wide")(
    lambda t: t.spark.read.parquet(bs.write_bars(t.bars_wide(), scratch(t.spark, "bars"))))


def _stored(t, source: str = "parquet") -> str:
    """The daily bars in files of their own, without an adjusted close."""
    path = scratch(t.spark, "bars")
    bars = t.bars_daily().withColumn("ts", F.col("ts").cast("timestamp"))
    if source == "csv":
        bars.select(*[f for f in bs.BAR_SCHEMA.names if f != "adj_close"]).withColumn(
            "adj_close", F.lit(None).cast("double")).select(*bs.BAR_SCHEMA.names).write.option("header", True).csv(path)
    else:
        bs.write_bars(bars, path)
    return path


_READ = f"""{DAILY_SQL} SELECT symbol, ts, open, close, volume FROM bars_daily
WHERE symbol IN ('1-URGENT', '5-LOW') AND ts >= DATE '1996-03-01' AND ts < DATE '1997-03-01'"""
for _source in ("parquet", "csv"):
    query(f"bars_read_{_source}", ["symbol", "ts"], {"open": 2, "close": 2, "volume": 1}, _READ)(
        lambda t, source=_source: bs.read_bars(
            t.spark, _stored(t, source), source, ["1-URGENT", "5-LOW"], dt.datetime(1996, 3, 1), dt.datetime(1997, 3, 1)
        ).withColumn("ts", F.col("ts").cast("date")))
query("bars_load_month", ["symbol", "ts"], {"open": 2, "high": 2, "low": 2, "close": 2, "volume": 1}, f"""{DAILY_SQL}
SELECT symbol, CAST(date_trunc('month', b.ts) AS DATE) AS ts, min_by(open, b.ts) AS open, max(high) AS high, min(low) AS low,
  max_by(close, b.ts) AS close, sum(volume) AS volume
FROM bars_daily b WHERE symbol IN ('1-URGENT', '5-LOW') AND b.ts >= DATE '1996-03-01' AND b.ts < DATE '1997-03-01'
GROUP BY symbol, CAST(date_trunc('month', b.ts) AS DATE)""")(
    lambda t: bs.load_bars(t.spark, _stored(t), ["1-URGENT", "5-LOW"], dt.datetime(1996, 3, 1), dt.datetime(1997, 3, 1), "1mo"))
query("close_records", ["symbol", "ts"], {"close": 2}, f"{DAILY_SQL} SELECT symbol, ts, close FROM bars_daily")(
    lambda t: bs.closes(t.bars_daily()))

query("latest_snapshot", ["symbol", "as_of"], {"close": 2, "sma": 4}, f"""{DAILY_SQL}
SELECT symbol, ts AS as_of, close, sma FROM (
  SELECT *, {full('avg', 'close', 5)} AS sma, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS d FROM bars_daily)
WHERE d = 1""")(lambda t: bs.latest_snapshot(t.bars_daily(), 5, DAILY))

query("latest_row", ["symbol", "ts"], {"close": 2, "high": 2}, f"""{DAILY_SQL}
SELECT b.symbol, b.ts, close, high FROM bars_daily b
JOIN (SELECT symbol, max(ts) AS ts FROM bars_daily GROUP BY symbol) m ON b.symbol = m.symbol AND b.ts = m.ts""")(
    lambda t: bs.latest_row(t.bars_daily()))

# -- features --------------------------------------------------------------------


def _features_sql() -> str:
    cols = [f"{lag('close', k)} AS lag_{k}" for k in ft.LAGS]
    for w in ft.WINDOWS:
        cols += [f"{full('avg', 'close', w)} AS sma_{w}", f"{full('stddev_samp', 'close', w)} AS vol_{w}"]
    cols += [f"close / {lag('close', k)} - 1 AS returns_{k}d" for k in ft.RETURNS]
    cols.append(f"lead(close, 1) OVER ({W}) AS target")
    return over("SELECT symbol, ts, close FROM bars_daily", *cols)


_NEED = " AND ".join(f"{c} IS NOT NULL" for c in [*ft.feature_names(), "target"])
# a mean of 120 two-decimal prices can end in exactly ...5 at four decimals
_RND = {c: {"ret": 7, "sma": 5}.get(c[:3], 4) for c in [*ft.feature_names(), "target"]}
query("features", ["symbol", "ts"], _RND, f"{DAILY_SQL} SELECT * FROM ({_features_sql()}) f WHERE {_NEED}")(
    lambda t: ft.make_features(t.bars_daily(), axis=DAILY))
query("feature_counts", ["symbol", "features", "samples", "dropped"], {}, f"""{DAILY_SQL}
SELECT symbol, {len(ft.feature_names())} AS features, count(*) FILTER ({_NEED}) AS samples,
       count(*) FILTER (NOT ({_NEED})) AS dropped FROM ({_features_sql()}) f GROUP BY symbol""")(
    lambda t: ft.feature_counts(t.bars_daily(), axis=DAILY))
def _observed(t):
    """The features are written once; what was seen, kept and dropped comes along."""
    seen = Observation()
    ft.make_features(t.bars_daily(), axis=DAILY, observed=seen).write.parquet(scratch(t.spark, "features"))
    return t.spark.createDataFrame([tuple(seen.get[c] for c in ("rows", "samples", "dropped"))], "rows long, samples long, dropped long")


query("feature_observed", ["rows", "samples", "dropped"], {}, f"""{DAILY_SQL}
SELECT count(*) AS rows, count(*) FILTER ({_NEED}) AS samples, count(*) FILTER (NOT ({_NEED})) AS dropped FROM ({_features_sql()}) f""")(_observed)
query("feature_ma_block", ["symbol", "ts"], {"ma": 7}, f"""{DAILY_SQL}
{over('SELECT symbol, ts, close FROM bars_daily', f"close / ({full('avg', 'close', 30)}) - 1 AS ma")}""")(
    lambda t: ft.feature_block(t.bars_daily(), {"name": "MovingAverage", "params": {"window": 30}}, DAILY))
query("features_wide", ["symbol", "ts"], {"lag_1": 2, "sma_20": 4, "vol_20": 4, "returns_5d": 7, "target": 2}, f"""{ctes('bars_wide')}
SELECT * FROM ({over('SELECT symbol, ts, close FROM bars_wide', f"{lag('close')} AS lag_1", f"{lag('close', 5)} AS lag_5",
    f"{full('avg', 'close', 20)} AS sma_20", f"{full('stddev_samp', 'close', 20)} AS vol_20",
    f"close / {lag('close')} - 1 AS returns_1d", f"close / {lag('close', 5)} - 1 AS returns_5d",
    f"lead(close, 1) OVER ({W}) AS target")}) f
WHERE lag_1 IS NOT NULL AND lag_5 IS NOT NULL AND vol_20 IS NOT NULL AND target IS NOT NULL""")(
    lambda t: ft.make_features(t.bars_wide().select("symbol", "ts", "close"), (1, 5), (20,), DAILY))

_RSI = (f"close - {lag('close')} AS d",)
query("model_frame", ["symbol", "ts"], {"SMA_5": 4, "SMA_10": 4, "RSI_5": 6}, f"""{DAILY_SQL}
SELECT symbol, ts, SMA_5, SMA_10, 100 - 100 / (1 + g / CASE WHEN l = 0 THEN 1e-9 ELSE l END) AS RSI_5 FROM (
{over(over(over('SELECT symbol, ts, close FROM bars_daily', *_RSI),
      'CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS dg', 'CASE WHEN d IS NOT NULL THEN -least(d, 0) END AS dl'),
      f"{full('avg', 'close', 5)} AS SMA_5", f"{full('avg', 'close', 10)} AS SMA_10",
      f"{full('avg', 'dg', 5)} AS g", f"{full('avg', 'dl', 5)} AS l")}) x
WHERE SMA_10 IS NOT NULL AND g IS NOT NULL""")(
    lambda t: model_frame(t.bars_daily(), [{"name": "rsi"}, {"name": "sma", "window": 10}], DAILY))

# -- splits and calendar -----------------------------------------------------------

SPLIT = """SELECT *, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train'
  WHEN rn <= floor(n * 0.7::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'valid' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n
      FROM {src})"""
query("split_ordered", ["symbol", "ts", "split"], {"close": 2}, f"{DAILY_SQL} {SPLIT.format(src='bars_daily')}")(
    lambda t: ft.split_ordered(t.bars_daily(), axis=DAILY))
query("split_fit_rows", ["symbol", "ts"], {"close": 2}, f"""{DAILY_SQL}
SELECT * FROM ({SPLIT.format(src='bars_daily')}) s WHERE split IN ('train', 'valid')""")(
    lambda t: ft.fit_rows(ft.split_ordered(t.bars_daily(), axis=DAILY)))
query("bars_union", ["symbol", "ts"], {"close": 2}, f"""{ctes('bars_daily', 'bars_wide')}
SELECT symbol, ts, close FROM bars_daily UNION ALL SELECT CAST(symbol AS VARCHAR), ts, close FROM bars_wide""")(
    lambda t: ft.union_rows([bs.closes(t.bars_daily()), bs.closes(t.bars_wide()).withColumn("symbol", F.col("symbol").cast("string"))]))

HOLIDAYS = (dt.date(1995, 1, 2), dt.date(1996, 12, 25), dt.date(2000, 7, 4))
NEXT = "CAST(ts + CASE dayofweek(ts) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS DATE)"
query("next_bday", ["symbol", "ts", "next_day"], {}, f"{DAILY_SQL} SELECT symbol, ts, {NEXT} AS next_day FROM bars_daily")(
    lambda t: t.bars_daily().withColumn("next_day", next_weekday("ts")))
_OPEN = """days AS (SELECT CAST(d AS DATE) AS day FROM (
  SELECT unnest(generate_series((SELECT min(ts) FROM bars_daily), (SELECT max(ts) FROM bars_daily) + INTERVAL 40 DAY, INTERVAL 1 DAY)) AS d)),
opens AS (SELECT day FROM days WHERE dayofweek(day) BETWEEN 1 AND 5
  AND day NOT IN (DATE '1995-01-02', DATE '1996-12-25', DATE '2000-07-04'))"""
query("next_bday_holidays", ["symbol", "ts", "next_open"], {}, f"""{DAILY_SQL}, {_OPEN}
SELECT symbol, ts, (SELECT min(day) FROM opens WHERE day > ts) AS next_open FROM bars_daily""")(
    lambda t: _next_open(t.bars_daily()))


def _next_open(bars):
    first, last = bars.agg(F.min("ts"), F.max("ts")).first()
    return with_next_open(bars, "ts", business_calendar(bars.sparkSession, first, last, HOLIDAYS))


query("last30", ["symbol", "ts"], {"close": 2}, f"""{DAILY_SQL}
SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS d FROM bars_daily)
WHERE d <= 30""")(lambda t: ft.last_n(t.bars_daily(), 30, DAILY))

# -- preprocessing -------------------------------------------------------------------

_ST = """st AS (SELECT symbol, avg(close) AS a, stddev_samp(close) AS ss, stddev_pop(close) AS sp, min(close) AS lo,
  max(close) AS hi, quantile_cont(close, 0.25) AS q1, quantile_cont(close, 0.5) AS q2, quantile_cont(close, 0.75) AS q3
  FROM bars_gappy GROUP BY symbol)"""
_FROM = "FROM bars_gappy b JOIN st USING (symbol)"


def prep(name: str, fn, rnd: dict, sql: str, keep=("symbol", "ts")) -> None:
    query(f"prep_{name}", list(keep), rnd, sql)(lambda t: fn(t.bars_gappy()))


prep("dropna", pp.drop_missing, {"close": 2}, f"{GAPPY} SELECT * FROM bars_gappy WHERE close IS NOT NULL")
prep("mean", pp.fill_mean, {"close": 4}, f"{GAPPY}, {_ST} SELECT symbol, ts, coalesce(close, a) AS close {_FROM}")
prep("ffill", lambda d: pp.fill_previous(d, axis=DAILY), {"close": 2}, f"""{GAPPY}
SELECT symbol, ts, last_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM bars_gappy""")
prep("sigma", lambda d: pp.drop_sigma(d, k=1.5), {"close": 2},
     f"{GAPPY}, {_ST} SELECT symbol, ts, close {_FROM} WHERE abs(close - a) <= 1.5 * ss")
prep("outlier_removal", lambda d: pp.preprocess(d, {"OutlierRemoval": {"enable": "On", "value": {"threshold": 1}}}, axis=DAILY),
     {"close": 2}, f"{GAPPY}, {_ST} SELECT symbol, ts, close {_FROM} WHERE abs(close - a) <= ss")
prep("iqr", lambda d: pp.drop_iqr(d, k=0.5, max_rows=DAILY.max_rows), {"close": 2},
     f"{GAPPY}, {_ST} SELECT symbol, ts, close {_FROM} WHERE close BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)")
prep("zscore", lambda d: pp.zscore(d, limit=1.5), {"z": 6},
     f"{GAPPY}, {_ST} SELECT symbol, ts, (close - a) / ss AS z, abs((close - a) / ss) > 1.5 AS outlier {_FROM}",
     ("symbol", "ts", "outlier"))
prep("robust", lambda d: pp.robust_scale(d, max_rows=DAILY.max_rows), {"scaled": 6},
     f"{GAPPY}, {_ST} SELECT symbol, ts, (close - q2) / (q3 - q1) AS scaled {_FROM}")
prep("minmax", pp.min_max, {"scaled": 7}, f"{GAPPY}, {_ST} SELECT symbol, ts, (close - lo) / (hi - lo) AS scaled {_FROM}")
prep("normalize_range", lambda d: pp.preprocess(d, {"Normalization": {"enable": "On", "value": {"range": [-1, 1]}}}, axis=DAILY),
     {"close_norm": 7}, f"{GAPPY}, {_ST} SELECT symbol, ts, (close - lo) / (hi - lo) * 2 - 1 AS close_norm {_FROM}")
prep("standard", pp.standardise, {"scaled": 6}, f"{GAPPY}, {_ST} SELECT symbol, ts, (close - a) / sp AS scaled {_FROM}")
prep("log", pp.log_transform, {"log": 7},
     f"{GAPPY} SELECT symbol, ts, CASE WHEN close > 0 THEN ln(close) END AS log FROM bars_gappy")
prep("boxcox", lambda d: pp.box_cox(d, lam=0.5), {"boxcox": 5},
     f"{GAPPY} SELECT symbol, ts, CASE WHEN close > 0 THEN (pow(close, 0.5) - 1) / 0.5 END AS boxcox FROM bars_gappy")
# whole preprocessing sections of a plan: every block works on what the one before it kept
_PLAN = {
    "missing_value_methods": {"enable": "On", "value": ["平均補完"]}, "outlier_methods": {"enable": "On", "value": ["IQR法"]},
    "scaling_methods": {"enable": "On", "value": ["MinMaxスケーリング", "標準化"]},
    "feature_generation_methods": {"enable": "On", "value": ["多項式展開", "対数変換"]},
}
_REFILLED = {
    "missing_value_methods": {"enable": "On", "value": ["前日値で補完"]},
    "outlier_methods": {"enable": "On", "value": ["3σ法", "Zスコア法", "ロバストスケーリング法"]},
    "scaling_methods": {"enable": "Off", "value": ["標準化"]},
    "Normalization": {"enable": "On", "value": {"range": [0, 10]}}, "OutlierRemoval": {"enable": "On", "value": {"threshold": 2}},
}
prep("plan", lambda d: pp.preprocess(d, _PLAN, axis=DAILY), {"close_minmax": 5, "close_std": 5, "close_x_close": 1, "close_log": 6}, f"""{GAPPY},
m AS (SELECT symbol, avg(close) AS a FROM bars_gappy GROUP BY symbol),
f AS (SELECT symbol, ts, coalesce(close, a) AS close FROM bars_gappy JOIN m USING (symbol)),
q AS (SELECT symbol, quantile_cont(close, 0.25) AS q1, quantile_cont(close, 0.75) AS q3 FROM f GROUP BY symbol),
k AS (SELECT symbol, ts, close FROM f JOIN q USING (symbol) WHERE close BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
s AS (SELECT symbol, min(close) AS lo, max(close) AS hi, avg(close) AS a, stddev_pop(close) AS sp FROM k GROUP BY symbol)
SELECT symbol, ts, coalesce((close - lo) / nullif(hi - lo, 0), 0) AS close_minmax, (close - a) / nullif(sp, 0) AS close_std,
  close * close AS close_x_close, CASE WHEN close > 0 THEN ln(close) END AS close_log FROM k JOIN s USING (symbol)""")
prep("plan_refilled", lambda d: pp.preprocess(d, _REFILLED, axis=DAILY), {"z": 5, "close_robust": 5, "close_norm": 5}, f"""{GAPPY},
f AS (SELECT symbol, ts, last_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM bars_gappy),
m AS (SELECT symbol, avg(close) AS a, stddev_samp(close) AS ss FROM f GROUP BY symbol),
k AS (SELECT symbol, ts, close FROM f JOIN m USING (symbol) WHERE coalesce(abs(close - a) <= 3 * ss, close IS NOT NULL)),
s AS (SELECT symbol, min(close) AS lo, max(close) AS hi, avg(close) AS a, stddev_samp(close) AS ss, quantile_cont(close, 0.25) AS q1,
  quantile_cont(close, 0.5) AS q2, quantile_cont(close, 0.75) AS q3 FROM k GROUP BY symbol)
SELECT symbol, ts, (close - a) / nullif(ss, 0) AS z, abs((close - a) / nullif(ss, 0)) > 3 AS outlier, (close - q2) / nullif(q3 - q1, 0) AS close_robust,
  coalesce((close - lo) / nullif(hi - lo, 0), 0) * 10 AS close_norm
FROM k JOIN s USING (symbol) WHERE coalesce(abs(close - a) <= 2 * ss, close IS NOT NULL)""", ("symbol", "ts", "outlier"))
query("prep_boxcox_fit", ["symbol"], {"lam": 1}, f"""{GAPPY}, g AS (
  SELECT symbol, lam, count(*) AS n, sum(ln(close)) AS sl,
         var_pop(CASE WHEN lam = 0 THEN ln(close) ELSE (pow(close, lam) - 1) / lam END) AS v
  FROM bars_gappy, (SELECT CAST(x AS DOUBLE) / 2 AS lam FROM generate_series(-4, 4) s(x)) WHERE close > 0 GROUP BY symbol, lam)
SELECT symbol, max_by(lam, -n / 2.0 * ln(v) + (lam - 1) * sl) AS lam FROM g WHERE v > 0 GROUP BY symbol""")(
    lambda t: pp.box_cox_fit(t.bars_gappy()))
query("prep_poly", ["symbol", "ts"], {"high_x_high": 0, "high_x_low": 0, "low_x_low": 0}, f"""{DAILY_SQL}
SELECT symbol, ts, high * high AS high_x_high, high * low AS high_x_low, low * low AS low_x_low FROM bars_daily""")(
    lambda t: pp.polynomial(t.bars_daily(), ["high", "low"]))


# two columns: the axes are a rotation by the closed-form angle; the sign of an axis is arbitrary
query("prep_pca", ["symbol", "ts"], {"pc_1": 3, "pc_2": 3}, f"""{DAILY_SQL}, a AS (
  SELECT 0.5 * atan2(2 * covar_samp(high, low), var_samp(high) - var_samp(low)) AS th FROM bars_daily)
SELECT symbol, ts, abs(cos(th) * high + sin(th) * low) AS pc_1, abs(cos(th) * low - sin(th) * high) AS pc_2
FROM bars_daily, a""")(
    lambda t: pp.pca(t.bars_daily(), ["high", "low"], 2)[0].withColumns({"pc_1": F.abs("pc_1"), "pc_2": F.abs("pc_2")}))
query("feature_columns", ["symbol", "ts"], {"lag_1": 2, "lag_5": 2}, f"""{DAILY_SQL}
SELECT * FROM ({over('SELECT symbol, ts, close FROM bars_daily', f"{lag('close')} AS lag_1", f"{lag('close', 5)} AS lag_5",
    f"{full('avg', 'close', 5)} AS sma_5", f"lead(close, 1) OVER ({W}) AS target")}) f
WHERE lag_5 IS NOT NULL AND sma_5 IS NOT NULL AND target IS NOT NULL""")(
    lambda t: select_by_prefix(ft.make_features(t.bars_daily(), (1, 5), (5,), DAILY), ["symbol", "ts"], ["lag_"]))
