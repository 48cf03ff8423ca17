"""Models, forecasts, evaluation, checks and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomcast.functions.expr import digest_id
from loomcast.functions.series import DAILY, lay_out, settle
from loomcast.operators import check as ck
from loomcast.operators import features as ft
from loomcast.operators import models as md
from loomcast.operators.boosting import ALL, fit_per_series
from loomcast.operators.indicators import model_frame

from loomcast.sources import documents as dc
from loomcast.suite.indicator_queries import W, full, lag, over
from loomcast.suite.registry import query
from loomcast.suite.series_queries import DAILY_SQL, NEXT, SPLIT
from loomcast.suite.views import ctes

# -- least squares -------------------------------------------------------------------

_FRAME = f"""fr AS (SELECT *, lead(close, 1) OVER ({W}) AS target FROM (
  {over('SELECT symbol, ts, close FROM bars_daily', f"{full('avg', 'close', 5)} AS x")}) q WHERE x IS NOT NULL)"""
_ONE = f"""{DAILY_SQL}, {_FRAME}, m AS (SELECT symbol, regr_slope(target, x) AS slope, regr_intercept(target, x) AS intercept,
  count(*) AS n FROM fr WHERE target IS NOT NULL GROUP BY symbol)"""


def _train(t):
    return md.train_and_predict(model_frame(t.bars_daily(), [], DAILY), DAILY)


query("ols_one_feature", ["symbol", "n"], {"slope": 6, "intercept": 3}, f"{_ONE} SELECT * FROM m")(
    lambda t: _train(t)[0].withColumn("slope", F.col("coef")[0]))
query("ols_predictions", ["plan_id", "run_id", "symbol", "ts", "horizon", "model_id"], {"y_true": 2, "y_pred": 3}, f"""{_ONE}
SELECT 'plan_demo' AS plan_id, symbol AS run_id, symbol, ts, 1 AS horizon, 'linreg' AS model_id, target AS y_true,
  intercept + slope * x AS y_pred FROM fr JOIN m USING (symbol) WHERE target IS NOT NULL""")(
    lambda t: md.prediction_rows(_train(t)[1], F.lit("plan_demo"), F.col("symbol")))
query("last30_fitted", ["symbol", "day"], {"price": 3}, f"""{_ONE}
SELECT symbol, {NEXT} AS day, intercept + slope * x AS price FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS d FROM fr WHERE target IS NOT NULL) z
JOIN m USING (symbol) WHERE d <= 30""")(
    lambda t: ft.last_n(_train(t)[1], 30).select("symbol", md.next_weekday("ts").alias("day"), F.col("y_pred").alias("price")))
query("predict_next", ["symbol", "as_of", "next_day"], {"close": 2, "next_close": 3}, f"""{_ONE}
SELECT symbol, ts AS as_of, close, {NEXT} AS next_day, intercept + slope * x AS next_close
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS d FROM fr) z JOIN m USING (symbol) WHERE d = 1""")(
    lambda t: md.predict_next(t.bars_daily(), [], DAILY))

_TWO = """SELECT symbol, n, b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM (
  SELECT *, (c22 * y1 - c12 * y2) / (c11 * c22 - c12 * c12) AS b1, (c11 * y2 - c12 * y1) / (c11 * c22 - c12 * c12) AS b2 FROM (
    SELECT symbol, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS c11, var_pop(x2) AS c22,
      covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS y1, covar_pop(x2, y) AS y2 FROM {src} GROUP BY symbol))"""
_F2 = f"""f2 AS (SELECT symbol, lag_1 AS x1, sma_5 AS x2, target AS y FROM (
  {over('SELECT symbol, ts, close FROM bars_daily', f"{lag('close')} AS lag_1", f"{lag('close', 5)} AS l5",
        f"{full('avg', 'close', 5)} AS sma_5", f"lead(close, 1) OVER ({W}) AS target")}) q
  WHERE lag_1 IS NOT NULL AND l5 IS NOT NULL AND sma_5 IS NOT NULL AND target IS NOT NULL)"""
query("ols_multi", ["symbol", "n"], {"b0": 3, "b1": 6, "b2": 6}, f"{DAILY_SQL}, {_F2} {_TWO.format(src='f2')}")(
    lambda t: md.fit_ols(ft.make_features(t.bars_daily(), (1,), (5,), DAILY), ["lag_1", "sma_5"]).select(
        "symbol", "n", F.col("intercept").alias("b0"), F.col("coef")[0].alias("b1"), F.col("coef")[1].alias("b2")))
query("ols_wide", ["symbol", "n"], {"slope": 6, "intercept": 3}, f"""{ctes('bars_wide')}, fr AS (
  SELECT symbol, {lag('close')} AS x, close AS y FROM bars_wide)
SELECT symbol, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, count(x) AS n FROM fr WHERE x IS NOT NULL GROUP BY symbol""")(
    lambda t: _wide_ols(t))


def _wide_ols(t):
    b = lay_out(t.bars_wide().select("symbol", "ts", "close"), DAILY, 1)
    rows = b.add({"x": b.lag("close")}).rows()
    return md.fit_ols(rows, ["x"], "close").withColumn("slope", F.col("coef")[0])


@query("boosted_forecast", ["symbol", "ts"], {"y_true": 2, "y_pred": 2})
def _boosted(t):
    return md.train_boosted(t.bars_daily(), axis=DAILY)[1]


@query("boosted_record", ["run_id"], {"r2": 4, "mae": 2, "rmse": 2, "mape": 3})
def _record(t):
    scored = md.train_boosted(t.bars_daily(), loss="lad", axis=DAILY)[1]
    return md.train_record(scored, digest_id("run-", "symbol"))


def first_split(t, loss):
    """First tree of one split for every series: where it cuts, and its two leaves."""
    rows = ft.make_features(t.bars_daily(), (1,), (5,), DAILY)
    model = fit_per_series(rows, ["lag_1", "sma_5"], "target", DAILY.key, loss, 1, 1, 1.0)
    tree, edges = F.col("trees")[0], F.col("edges")
    f = tree["f"][0]
    return model.select(
        "symbol", F.col("start"), F.when(tree["b"][0] < ALL, f).alias("feature"),
        F.when(tree["b"][0] < ALL, F.get(F.get(edges, f), tree["b"][0].cast("int"))).alias("cut"),
        tree["v"][0].alias("leaf_left"), tree["v"][1].alias("leaf_right"),
    )


#: start, gradient and leaf of the losses
_LOSS_SQL = {
    "ls": ("avg(y)", "r", "avg(r)"),
    "lad": ("quantile_disc(y, 0.5)", "sign(r)", "max(med)"),
    "huber": ("quantile_disc(y, 0.5)", "sign(r) * least(abs(r), w)", "max(med) + avg(sign(r - med) * least(abs(r - med), w))"),
}
for _loss, (_start, _grad, _leaf) in _LOSS_SQL.items():
    query(f"boosted_first_{_loss}", ["symbol", "feature"], {"start": 3, "cut": 4, "leaf_left": 3, "leaf_right": 3}, f"""{DAILY_SQL}, {_F2},
st AS (SELECT symbol, {_start} AS start FROM f2 GROUP BY symbol),
rs AS (SELECT f2.symbol, x1, x2, y - start AS r FROM f2 JOIN st ON f2.symbol = st.symbol),
wd AS (SELECT symbol, quantile_disc(abs(r), 0.9) AS w FROM rs GROUP BY symbol),
g AS (SELECT rs.symbol, x1, x2, r, w, {_grad} AS g FROM rs JOIN wd ON rs.symbol = wd.symbol),
x AS (SELECT symbol, 0 AS f, x1 AS x, g FROM g UNION ALL SELECT symbol, 1, x2, g FROM g),
e AS (SELECT DISTINCT symbol, f, unnest(q) AS e FROM (
  SELECT symbol, f, quantile_disc(x, [{', '.join(f'{i}/32.0' for i in range(1, 32))}]::DOUBLE[]) AS q FROM x GROUP BY symbol, f) z),
c AS (SELECT x.symbol, x.f, e, sum(g) FILTER (x <= e) AS gl, count(*) FILTER (x <= e) AS nl, sum(g) FILTER (x > e) AS gr,
  count(*) FILTER (x > e) AS nr FROM x JOIN e ON x.symbol = e.symbol AND x.f = e.f GROUP BY x.symbol, x.f, e),
s AS (SELECT *, (gl / nl - gr / nr) ** 2 * nl * nr / (nl + nr) AS gain FROM c WHERE nl > 0 AND nr > 0),
b AS (SELECT symbol, f, e FROM (SELECT *, max(gain) OVER (PARTITION BY symbol) AS top FROM s) z
  WHERE gain >= top * (1 - 1e-9) AND gain > 1e-24 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY f, e) = 1),
n AS (SELECT g.*, f, e, coalesce(CASE WHEN f = 0 THEN x1 ELSE x2 END > e, false) AS right_side FROM g LEFT JOIN b ON g.symbol = b.symbol),
m AS (SELECT *, quantile_disc(r, 0.5) OVER (PARTITION BY symbol, right_side) AS med FROM n),
l AS (SELECT symbol, right_side, any_value(f) AS f, any_value(e) AS e, {_leaf} AS v FROM m GROUP BY symbol, right_side)
SELECT l.symbol, any_value(start) AS start, any_value(f) AS feature, any_value(e) AS cut, max(v) FILTER (NOT right_side) AS leaf_left,
  coalesce(max(v) FILTER (right_side), 0.0) AS leaf_right FROM l JOIN st ON l.symbol = st.symbol GROUP BY l.symbol""")(
        lambda t, k=_loss: first_split(t, k))


# -- baselines, intervals, ensembles ----------------------------------------------------

_DAYS = """days AS (SELECT CAST(d AS DATE) AS day FROM (
  SELECT unnest(generate_series((SELECT min(ts) FROM bars_daily), (SELECT max(ts) FROM bars_daily) + INTERVAL 400 DAY, INTERVAL 1 DAY)) AS d)
  WHERE dayofweek(d) BETWEEN 1 AND 5)"""
for _s, _agg in (("mean", "avg(close)"), ("median", "quantile_cont(close, 0.5)"), ("last", "max_by(close, ts)")):
    query(f"baseline_{_s}", ["symbol", "horizon", "date"], {"y_pred": 4}, f"""{DAILY_SQL}, {_DAYS},
l AS (SELECT symbol, max(ts) AS last FROM bars_daily GROUP BY symbol),
v AS (SELECT b.symbol, any_value(last) AS last, {_agg} AS y_pred FROM bars_daily b JOIN l ON b.symbol = l.symbol
      WHERE ts > last - 30 GROUP BY b.symbol),
h AS (SELECT symbol, y_pred, day AS date, row_number() OVER (PARTITION BY symbol ORDER BY day) AS horizon
      FROM v JOIN days ON day > last)
SELECT symbol, CAST(horizon AS INTEGER) AS horizon, date, y_pred FROM h WHERE horizon <= 7""")(
        lambda t, s=_s: md.baseline_forecast(t.bars_daily(), 30, 7, s, DAILY))

query("interval_forecast", ["symbol", "horizon"], {"p5": 4, "p50": 4, "p95": 4, "vector": 7}, f"""{DAILY_SQL},
r AS (SELECT symbol, h AS horizon, close / lag(close, CAST(h AS INTEGER)) OVER (PARTITION BY symbol, h ORDER BY ts) - 1 AS ret
      FROM bars_daily, (VALUES (1), (5), (20)) hs(h)),
q AS (SELECT symbol, horizon, quantile_cont(ret, 0.05) AS q5, quantile_cont(ret, 0.5) AS q50, quantile_cont(ret, 0.95) AS q95
      FROM r WHERE ret IS NOT NULL GROUP BY symbol, horizon),
n AS (SELECT symbol, max_by(close, ts) AS now FROM bars_daily GROUP BY symbol)
SELECT symbol, horizon, now * (1 + q5) AS p5, now * (1 + q50) AS p50, now * (1 + q95) AS p95, q50 AS vector
FROM q JOIN n USING (symbol)""")(lambda t: md.interval_forecast(t.bars_daily(), [5, 1, 20, 0, 5], DAILY))


def two_models(t):
    """Last value, and the mean of the five values before a row."""
    b = lay_out(t.bars_daily().select("symbol", "ts", "close"), DAILY, 5)
    five = b.w.rowsBetween(-5, -1)
    df = b.add({"naive": b.lag("close"), "ma": F.when(F.count("close").over(five) >= 5, F.avg("close").over(five))}).rows()
    long = df.where("ma IS NOT NULL").unpivot(["symbol", "ts", "close"], ["naive", "ma"], "model_id", "y_pred")
    return long.withColumnRenamed("close", "y_true").withColumn("horizon", F.lit(1))


_TM = f"""tm AS (SELECT * FROM ({over('SELECT symbol, ts, close FROM bars_daily', f"{lag('close')} AS naive",
  f"CASE WHEN count(close) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) >= 5 THEN "
  f"avg(close) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END AS ma")}) q WHERE ma IS NOT NULL)"""
query("ensemble_weighted", ["symbol", "ts", "horizon", "models"], {"y_pred": 4, "y_true": 2}, f"""{DAILY_SQL}, {_TM}
SELECT symbol, ts, 1 AS horizon, CAST(2 AS BIGINT) AS models, (0.5 * naive + 2.0 * ma) / 2.5 AS y_pred, close AS y_true FROM tm""")(
    lambda t: md.ensemble_weighted(two_models(t), {"naive": 0.5, "ma": 2.0}))
query("ensemble_equal", ["symbol", "ts", "horizon", "models"], {"y_pred": 4, "y_true": 2}, f"""{DAILY_SQL}, {_TM}
SELECT symbol, ts, 1 AS horizon, CAST(2 AS BIGINT) AS models, (naive + ma) / 2 AS y_pred, close AS y_true FROM tm""")(
    lambda t: md.ensemble_weighted(two_models(t)))
_PARTS = f"parts AS ({SPLIT.format(src='tm')})"
_MODEL2 = _TWO.format(src="(SELECT symbol, naive AS x1, ma AS x2, close AS y FROM parts WHERE split = 'valid')")
query("ensemble_stacked", ["symbol", "ts"], {"y_true": 2, "y_pred": 3}, f"""{DAILY_SQL}, {_TM}, {_PARTS},
m AS ({_MODEL2})
SELECT p.symbol, ts, close AS y_true, b0 + b1 * naive + b2 * ma AS y_pred FROM parts p JOIN m ON p.symbol = m.symbol
WHERE split = 'test'""")(lambda t: md.ensemble_stacked(two_models(t), ["naive", "ma"], axis=DAILY))

# -- evaluation -----------------------------------------------------------------------------

PRED = ctes("predictions")
RES, TOT = "sum((y_true - y_pred) * (y_true - y_pred))", "(var_pop(y_true) * count(*))"
APE = "abs((y_true - y_pred) / nullif(y_true, 0))"
SCORES = {
    "check": (f"coalesce(1 - {RES} / nullif({TOT}, 0), 0)", f"CASE WHEN count(*) FILTER (y_true = 0) = 0 THEN avg({APE}) * 100 END"),
    "calc": (f"CASE WHEN count(*) >= 2 THEN coalesce(1 - {RES} / nullif({TOT}, 0), CASE WHEN {RES} = 0 THEN 1.0 ELSE 0.0 END) END",
             f"CASE WHEN count(*) FILTER (y_true = 0 AND y_pred = 0) = 0 THEN avg({APE}) * 100 END"),
    "guarded": (f"CASE WHEN count(*) >= 2 THEN coalesce(1 - {RES} / nullif({TOT}, 0), CASE WHEN {RES} = 0 THEN 1.0 ELSE 0.0 END) END",
                "avg(abs(y_true - y_pred) / greatest(abs(y_true), 2.220446049250313e-16)) * 100"),
    "corr": ("pow(corr(y_true, y_pred), 2)", f"CASE WHEN count(*) FILTER (y_true = 0) = 0 THEN avg({APE}) * 100 END"),
}


def bundle(family: str, by: str, src: str = "predictions", group: str | None = None) -> str:
    r2, mape = SCORES[family]
    return f"""SELECT {by}, {r2} AS r2, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse,
  {mape} AS mape, count(*) AS n FROM {src} GROUP BY {group or by}"""


RND = {"r2": 7, "mae": 4, "rmse": 4, "mape": 5}
for _f in SCORES:
    query(f"eval_{_f}", ["plan_id", "run_id", "n"], RND, f"{PRED} {bundle(_f, 'plan_id, run_id')}")(
        lambda t, f=_f: ck.score_runs(t.predictions(), family=f))
query("eval_rounded", ["run_id", "r2", "mae", "rmse", "mape"], {}, f"""{PRED}, s AS ({bundle('check', 'run_id')})
SELECT run_id, round(r2, 4) AS r2, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(mape, 2) AS mape FROM s""")(
    lambda t: ck.rounded_scores(ck.score_runs(t.predictions(), ["run_id"])))
query("eval_zero_actuals", ["run_id", "n"], RND, f"""{PRED}, z AS (SELECT run_id,
  CASE WHEN run_id = '1-URGENT' AND day(ts) = 1 THEN 0.0 ELSE y_true END AS y_true,
  CASE WHEN run_id = '2-HIGH' THEN y_true ELSE y_pred END AS y_pred FROM predictions)
{bundle('calc', 'run_id', 'z')}""")(
    lambda t: ck.score_runs(t.predictions().withColumns({
        "y_true": F.when((F.col("run_id") == "1-URGENT") & (F.dayofmonth("ts") == 1), 0.0).otherwise(F.col("y_true")),
        "y_pred": F.when(F.col("run_id") == "2-HIGH", F.col("y_true")).otherwise(F.col("y_pred"))}), ["run_id"], "calc"))
query("eval_rollup", ["run_id", "year", "n"], RND, f"""{PRED}, y AS (SELECT *, CAST(year(ts) AS INTEGER) AS year FROM predictions)
{bundle('check', 'run_id, year', 'y', 'ROLLUP (run_id, year)')}""")(
    lambda t: ck.score_rollup(t.predictions().withColumn("year", F.year("ts")), ["run_id", "year"]))

# -- checks and decisions ---------------------------------------------------------------------

_SC = f"s AS ({bundle('check', 'plan_id, run_id')})"
_CHECKS = f"""{ctes('predictions', 'meta')}, {_SC}, l AS (
  SELECT plan_id, run_id, 'mape' AS metric, mape AS value FROM s UNION ALL SELECT plan_id, run_id, 'rmse', rmse FROM s
  UNION ALL SELECT plan_id, run_id, 'r2', r2 FROM s),
c AS (SELECT plan_id, run_id, l.metric, value, threshold,
  CASE WHEN l.metric = 'r2' THEN value >= threshold ELSE value <= threshold END AS passed FROM l JOIN meta m ON l.metric = m.metric)"""
query("metric_checks", ["plan_id", "run_id", "metric", "passed"], {"value": 4, "threshold": 4}, f"{_CHECKS} SELECT * FROM c")(
    lambda t: ck.metric_checks(ck.score_runs(t.predictions()), t.meta()))
_REPORT = f"""{_CHECKS}, rep AS (SELECT plan_id, run_id, concat('check_', substr(sha256(concat(length(plan_id), ':', plan_id, length(run_id), ':', run_id)), 1, 32)) AS check_id,
  coalesce(max(CASE WHEN metric = 'r2' THEN value END), 0) AS r2, coalesce(max(CASE WHEN metric = 'r2' THEN threshold END), 0) AS threshold,
  bool_and(CASE WHEN metric = 'r2' THEN passed END) AS passed, bool_and(passed) AS overall_passed FROM c GROUP BY plan_id, run_id)"""


def _report(t):
    return ck.check_report(ck.metric_checks(ck.score_runs(t.predictions()), t.meta()), t.runs())


query("check_report", ["plan_id", "run_id", "check_id", "passed", "overall_passed"], {"r2": 6, "threshold": 2},
      f"{_REPORT} SELECT * FROM rep")(_report)
_ACT = """SELECT plan_id, run_id, check_id, concat('act-', substr(sha256(concat(length(check_id), ':', check_id)), 1, 32)) AS act_id,
  CASE WHEN r2 >= threshold THEN 'noop' ELSE 'retrain' END AS action,
  CASE WHEN r2 >= threshold THEN 'accuracy within threshold'
       ELSE printf('low accuracy (r2=%.3f < %.2f)', r2, threshold) END AS reason FROM rep"""
query("act_decision", ["plan_id", "run_id", "check_id", "act_id", "action", "reason"], {}, f"{_REPORT} {_ACT}")(
    lambda t: ck.decide(_report(t)))
query("gate_flags", ["run_id", "passed"], {"r2": 6}, f"{PRED}, {_SC} SELECT run_id, r2, r2 >= 0.8 AS passed FROM s")(
    lambda t: ck.gate(ck.score_runs(t.predictions())))


@query("run_cycle", ["run_id", "check_id", "passed", "action", "reason"], {"r2": 6, "rmse": 3, "mape": 4}, f"""{_ONE},
predictions AS (SELECT 'plan_demo' AS plan_id, symbol AS run_id, target AS y_true, intercept + slope * x AS y_pred
  FROM fr JOIN m USING (symbol) WHERE target IS NOT NULL), {_SC},
rep AS (SELECT *, concat('check_', substr(sha256(concat(length(plan_id), ':', plan_id, length(run_id), ':', run_id)), 1, 32)) AS check_id, 0.8::DOUBLE AS threshold FROM s)
SELECT run_id, check_id, r2, rmse, mape, r2 >= threshold AS passed, action, reason FROM rep JOIN (
  {_ACT}) a USING (run_id, check_id)""")
def _cycle(t):
    """Bars -> indicators -> regression -> predictions -> scores -> check -> decision."""
    pred = md.prediction_rows(_train(t)[1], F.lit("plan_demo"), F.col("symbol"))
    scores = settle(ck.score_runs(pred))
    meta = scores.select("plan_id", "run_id", F.lit("r2").alias("metric"), F.lit(0.8).alias("threshold"))
    reports = ck.check_report(ck.metric_checks(scores, meta), scores)
    acts = ck.decide(reports).select("run_id", "action", "reason")
    return reports.drop("r2").join(acts, "run_id").join(scores.select("run_id", "r2", "rmse", "mape"), "run_id")


def _ready(t):
    e = t.read("events")
    checks = e.select(F.concat(F.lit("check-"), F.col("user_id").cast("string")).alias("check_id"),
                      F.concat(F.lit("do-"), F.col("user_id").cast("string")).alias("do_id")).distinct()
    runs = dc.latest(t.status_log().select("tenant_id", "id", "seq", "created_at", "status", "value")).select(
        F.col("id").alias("do_id"), "status",
        F.when(F.col("value") < 20, F.create_map(F.lit("r2"), "value")).otherwise(F.create_map(
            F.lit("r2"), "value", F.lit("threshold"), F.lit(0.8), F.lit("passed"), F.lit(1.0))).alias("result"))
    return ck.ready_checks(checks, runs)


query("check_ready", ["check_id", "do_id", "state", "missing"], {}, f"""{ctes('status_log')},
l AS (SELECT id, user_id, max_by(status, seq) AS status, max_by(value, seq) AS value FROM status_log GROUP BY id, user_id)
SELECT concat('check-', CAST(user_id AS VARCHAR)) AS check_id, id AS do_id,
  CASE WHEN status = 'DONE' AND value >= 20 THEN 'READY' ELSE 'WAITING' END AS state,
  CASE WHEN status = 'DONE' THEN CASE WHEN value < 20 THEN 'threshold,passed' ELSE '' END END AS missing FROM l""")(_ready)
query("report_status", ["event_id", "state"], {}, """
SELECT event_id, CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILURE'
  ELSE CASE WHEN value > 50 THEN 'SUCCESS' ELSE 'FAILURE' END END AS state FROM events""")(
    lambda t: t.read("events").select("event_id", ck.report_status(
        F.when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("event_type") == "error", "FAILURE"),
        F.col("value") > 50).alias("state")))


def _shards(t):
    e = t.read("events").select(F.col("user_id").alias("run_id"), (F.col("event_id") % 12).alias("epoch"), "event_type")
    return ck.progress(e, e.where("event_type IN ('purchase', 'click')"))


query("shard_progress", ["run_id", "done", "status"], {"progress": 6}, """
SELECT user_id AS run_id, count(DISTINCT CASE WHEN event_type IN ('purchase', 'click') THEN event_id % 12 END) AS done,
  count(DISTINCT CASE WHEN event_type IN ('purchase', 'click') THEN event_id % 12 END) / 12.0::DOUBLE AS progress,
  CASE WHEN count(DISTINCT CASE WHEN event_type IN ('purchase', 'click') THEN event_id % 12 END) >= 12 THEN 'SUCCESS'
       ELSE 'IN_PROGRESS' END AS status FROM events GROUP BY user_id""")(_shards)


def _chain(t):
    plans = t.read("customer").select(F.col("c_custkey").alias("plan_id"))
    dos = t.read("orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("do_id"),
                                  F.col("o_orderstatus").alias("status"))
    checks = t.read("lineitem").groupBy(F.col("l_orderkey").alias("do_id")).agg((F.avg("l_discount") * 10).alias("r2")).select(
        "do_id", digest_id("check_", "do_id").alias("check_id"), "r2", F.lit(0.497).alias("threshold")).withColumn(
        "passed", F.col("r2") >= F.col("threshold"))
    return ck.chain(plans, dos, checks, ck.decide(checks))


query("run_chain", ["plan_id", "do_id", "check_id", "status", "passed", "action"], {"r2": 6}, """
WITH c AS (SELECT l_orderkey AS do_id, concat('check_', substr(sha256(concat(length(CAST(l_orderkey AS VARCHAR)), ':', l_orderkey)), 1, 32)) AS check_id,
  avg(l_discount) * 10 AS r2 FROM lineitem GROUP BY l_orderkey)
SELECT c_custkey AS plan_id, o_orderkey AS do_id, check_id, o_orderstatus AS status, r2, r2 >= 0.497 AS passed,
  CASE WHEN r2 >= 0.497 THEN 'noop' WHEN r2 < 0.497 THEN 'retrain' END AS action
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN c ON c.do_id = o_orderkey""")(_chain)

# -- run metrics ----------------------------------------------------------------------------------

query("run_metrics_latest", ["run_id"], RND, f"{PRED}, {_SC} SELECT run_id, r2, mae, rmse, mape FROM s ORDER BY run_id DESC LIMIT 1")(
    lambda t: ck.latest_metrics(ck.score_runs(t.predictions())))
query("run_metrics_min_r2", ["run_id"], RND, f"{PRED}, {_SC} SELECT * FROM s WHERE r2 >= -1.05")(
    lambda t: ck.list_metrics(ck.score_runs(t.predictions()), -1.05))
query("latest_gauges", ["gauge"], {"value": 4}, f"""{PRED}, {_SC}, z AS (SELECT * FROM s ORDER BY run_id DESC LIMIT 1)
SELECT 'r2' AS gauge, r2 AS value FROM z UNION ALL SELECT 'mae', mae FROM z UNION ALL SELECT 'rmse', rmse FROM z
UNION ALL SELECT 'mape', mape FROM z""")(lambda t: ck.latest_gauges(ck.score_runs(t.predictions())))
