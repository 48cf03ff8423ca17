"""Regression and forecasting over many series at once."""

from __future__ import annotations

from typing import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcast.functions import evaluation as ev
from loomcast.functions.expr import next_weekday, ratio, with_next_open
from loomcast.functions.quantiles import exact_quantiles
from loomcast.functions.series import DAY, Axis, at_last, epoch_seconds, join_on, join_stats, lay_out, settle
from loomcast.operators.boosting import fit_per_series, predict_per_series
from loomcast.operators.features import LAGS, WINDOWS, feature_names, fit_rows, make_features, split_ordered
from loomcast.session import shared_dir
from loomcast.sources.bars import latest_row

# -- least squares -------------------------------------------------------------


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
    """Least-norm solution of the k x k normal equations of one group per row, on the
    correlation scale; collinear columns share their weight."""
    out = []
    for a, b in zip(xx, xy):
        k = len(b)
        cov = np.asarray(a, dtype=float).reshape(k, k)
        sd = np.sqrt(np.clip(np.diag(cov), 0.0, None))
        inv = np.divide(1.0, sd, out=np.zeros(k), where=sd > 0)
        corr = cov * np.outer(inv, inv)
        out.append(inv * (np.linalg.pinv(corr, rcond=1e-12, hermitian=True) @ (np.asarray(b, dtype=float) * inv)))
    return pd.Series([[float(v) for v in c] for c in out])


def fit_ols(df: DataFrame, features: Sequence[str], target: str = "target", key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Ordinary least squares per group: (key..., coef, intercept, n).

    Rows are only summed up (means and centred co-moments, combined map-side), so a
    group of any size costs one row per map task; the k x k system is then solved on one
    row per group.  One feature is closed form and stays out of Python.
    """
    if not features:
        raise ValueError("no features")
    rows = df.dropna(subset=[*features, target])
    k = len(features)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(target).alias("_ym")]
    aggs += [F.avg(x).alias(f"_m{i}") for i, x in enumerate(features)]
    aggs += [F.covar_pop(x, target).alias(f"_y{i}") for i, x in enumerate(features)]
    aggs += [F.covar_pop(features[i], features[j]).alias(f"_c{i}_{j}") for i in range(k) for j in range(i, k)]
    m = rows.groupBy(*key).agg(*aggs)
    if k == 1:
        coef: Column = F.array(F.coalesce(F.try_divide(F.col("_y0"), F.col("_c0_0")), F.lit(0.0)))
    else:
        full = F.array(*[F.col(f"_c{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)])
        coef = _solve(full, F.array(*[F.col(f"_y{i}") for i in range(k)]))
    m = m.withColumn("coef", coef)
    shift = sum((F.col("coef")[i] * F.col(f"_m{i}") for i in range(k)), F.lit(0.0))
    return m.select(*key, "coef", (F.col("_ym") - shift).alias("intercept"), "n")


def predict_ols(df: DataFrame, model: DataFrame, features: Sequence[str], key: Sequence[str] = ("symbol",), out: str = "y_pred") -> DataFrame:
    """Apply per-group coefficients to rows."""
    m = model.select(*key, F.col("coef").alias("_coef"), F.col("intercept").alias("_b0"))
    pred = sum((F.col("_coef")[i] * F.col(x) for i, x in enumerate(features)), F.col("_b0"))
    return join_stats(df, m, key).withColumn(out, pred).drop("_coef", "_b0")


def regression_features(df: DataFrame) -> list[str]:
    """The indicator columns a regression takes, by name prefix."""
    feats = [c for c in df.columns if c.startswith(("SMA_", "EMA_", "RSI_"))]
    if not feats:
        raise ValueError("no features")
    return feats


def add_target(df: DataFrame, axis: Axis = Axis()) -> DataFrame:
    """Next row's close; the last row of a series has none."""
    b = lay_out(df, axis, 0, 1)
    return b.add({"target": b.lead("close")}).rows()


def train_and_predict(df: DataFrame, axis: Axis = Axis()) -> tuple[DataFrame, DataFrame]:
    """Per series: fit next close on the indicator columns; (model, rows with y_pred).
    Rows without a target are left out, each prediction stays on its own row."""
    feats = regression_features(df)
    rows = add_target(df, axis).dropna(subset=["target", *feats])
    model = fit_ols(rows, feats, "target", axis.key)
    return model, predict_ols(rows, model, feats, axis.key)


def prediction_rows(df: DataFrame, plan_id: Column, run_id: Column, model_id: str = "linreg") -> DataFrame:
    """Rows of the prediction artifact."""
    return df.select(
        plan_id.alias("plan_id"), run_id.alias("run_id"), "symbol", "ts", F.lit(1).alias("horizon"),
        F.col("target").alias("y_true"), "y_pred", F.lit(model_id).alias("model_id"),
    ).dropna(subset=["y_true", "y_pred"])


# -- boosted trees -------------------------------------------------------------

#: Accepted loss names (old and new) and the trainer's own.
LOSSES = {"ls": "squared", "lad": "absolute", "squared_error": "squared", "absolute_error": "absolute"}


def train_boosted(
    bars: DataFrame, loss: str = "ls", train: float = 0.7, valid: float = 0.1, iterations: int = 100,
    max_depth: int = 3, step: float = 0.1, seed: int = 42, lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS, axis: Axis = Axis(), per_split: bool = False,
):
    """Boosted trees on all series together; (model, scored test rows).

    The target and the level features are taken relative to the close, so that series
    of any price level share one model.  Features look back only, so they are computed
    on the whole series and then split; ``per_split`` computes them inside each split,
    which costs each its own warm-up.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    shared_dir(bars.sparkSession)  # the trees cut their lineage there every ten iterations
    if loss not in LOSSES:
        raise ValueError(f"unsupported loss '{loss}', known: {', '.join(LOSSES)}")
    if per_split:
        parts = split_ordered(bars, train, valid, axis)
        inside = axis.but(key=(*axis.key, "split"))
        rows = make_features(parts, lags, windows, inside)
    else:
        rows = split_ordered(make_features(bars, lags, windows, axis), train, valid, axis)
    names = feature_names(lags, windows)
    rows = rows.withColumns({
        f"x_{c}": F.col(c) if c.startswith("returns") else F.try_divide(F.col(c), F.col("close")) for c in names
    }).withColumn("label", ratio("target", "close") - 1)
    feats = [f"x_{c}" for c in names]
    data = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="skip").transform(
        rows.dropna(subset=[*feats, "label"])
    )
    gbt = GBTRegressor(
        maxIter=iterations, maxDepth=max_depth, stepSize=step, seed=seed, lossType=LOSSES[loss],
        labelCol="label", predictionCol="_growth",
    )
    model = gbt.fit(fit_rows(data).select("features", "label"))
    scored = model.transform(data.where(F.col("split") == "test"))
    return model, scored.withColumn("y_pred", F.col("close") * (1 + F.col("_growth"))).select(
        *axis.key, axis.order, "close", F.col("target").alias("y_true"), "y_pred"
    )


def train_per_series(
    bars: DataFrame, loss: str = "ls", train: float = 0.7, valid: float = 0.1, iterations: int = 100, max_depth: int = 3,
    step: float = 0.1, lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS, axis: Axis = Axis(),
    per_split: bool = True, bins: int = 32,
) -> tuple[DataFrame, DataFrame]:
    """Boosted trees, one model for each series, all series in the same passes; (models, scored test rows).

    Trained on the training and validation rows of a series for its next close, with squared (``ls``), absolute
    (``lad``) or ``huber`` loss; features are computed inside each split, or on the whole series if not ``per_split``.
    A series without a complete training row has no model and no scored rows."""
    if per_split:
        parts = split_ordered(bars, train, valid, axis)
        rows = make_features(parts, lags, windows, axis.but(key=(*axis.key, "split")))
    else:
        rows = split_ordered(make_features(bars, lags, windows, axis), train, valid, axis)
    names = feature_names(lags, windows)
    model = fit_per_series(fit_rows(rows), names, "target", axis.key, loss, iterations, max_depth, step, bins)
    test = rows.where((F.col("split") == "test") & F.col("target").isNotNull())
    scored = predict_per_series(test, model, names, axis.key, max_depth=max_depth).where("y_pred IS NOT NULL")
    return model, scored.select(*axis.key, axis.order, "close", F.col("target").alias("y_true"), "y_pred")


def train_record(scored: DataFrame, run_id: Column) -> DataFrame:
    """One run_metrics row per series of a trained model."""
    return scored.groupBy(run_id.alias("run_id")).agg(
        ev.r2_score("y_true", "y_pred").alias("r2"), ev.mae("y_true", "y_pred").alias("mae"),
        ev.rmse("y_true", "y_pred").alias("rmse"), ev.mape_guarded("y_true", "y_pred").alias("mape"),
    )


def predict_next(bars: DataFrame, cfg: Sequence[Mapping], axis: Axis = Axis(), calendar: DataFrame | None = None) -> DataFrame:
    """Next close per series: model fitted on all rows with a target, applied to the
    features of the last row, dated with the next business day."""
    from loomcast.operators.indicators import model_frame

    frame = model_frame(bars, cfg, axis)
    feats = regression_features(frame)
    model = fit_ols(add_target(frame, axis), feats, "target", axis.key)
    last = predict_ols(latest_row(frame, axis), model, feats, axis.key)
    if calendar is not None:
        last = with_next_open(last, axis.order, calendar, "next_day")
    else:
        last = last.withColumn("next_day", next_weekday(axis.order))
    return last.select(*axis.key, F.col(axis.order).alias("as_of"), "close", "next_day", F.col("y_pred").alias("next_close"))


# -- baselines and intervals ---------------------------------------------------

def baseline_forecast(
    bars: DataFrame, lookback_days: int = 30, horizon: int = 7, strategy: str = "mean", axis: Axis = Axis(),
    calendar: DataFrame | None = None,
) -> DataFrame:
    """(key, horizon, date, y_pred): mean, median or last close of the last days of each
    series, for the next business days."""
    if strategy not in ("mean", "median", "last"):
        raise ValueError("strategy is mean, median or last")
    last = settle(bars.groupBy(*axis.key).agg(F.max(axis.order).alias("_last")))
    rows = join_on(bars, last, axis.key, rows=last.count())
    dtype = dict(bars.dtypes)[axis.order]
    age = epoch_seconds(F.col("_last"), dtype) - epoch_seconds(F.col(axis.order), dtype)
    recent = rows.where(age < lookback_days * DAY)
    if strategy == "median":
        value = exact_quantiles(recent, axis.key, "close", {"y_pred": 0.5}, axis.max_rows)
        value = value.join(last, list(axis.key))
    else:
        agg = F.avg("close") if strategy == "mean" else at_last(("close",), axis.order, *axis.tie)[0]
        value = recent.groupBy(*axis.key).agg(agg.alias("y_pred"), F.max("_last").alias("_last"))
    steps = value.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(*axis.key, "horizon", business_day_after(F.to_date("_last"), F.col("horizon")).alias("date"), "y_pred")


def business_day_after(day: Column, n: Column) -> Column:
    """The n-th weekday after a date (n >= 1): whole weeks, then a step over the weekend."""
    wd = F.weekday(day)  # Monday 0 .. Sunday 6
    base = F.when(wd == 5, F.date_sub(day, 1)).when(wd == 6, F.date_sub(day, 2)).otherwise(day)
    w = F.least(wd, F.lit(4))
    total = w + n
    return F.date_add(base, (n + F.lit(2) * F.floor(total / 5)).cast("int"))


def interval_forecast(bars: DataFrame, horizons: Sequence[int], axis: Axis = Axis()) -> DataFrame:
    """(key, horizon, p5, p50, p95, vector): quantiles of the h-row returns of a series
    applied to its current close; vector = p50/current - 1."""
    hs = sorted({int(h) for h in horizons if int(h) > 0})
    if not hs:
        raise ValueError("no horizon above 0")
    b = lay_out(bars.select(*axis.key, axis.order, *axis.tie, "close"), axis, max(hs))
    wide = b.add({f"_r{h}": ratio("close", b.lag("close", h)) - 1 for h in hs}).rows()
    long = wide.select(
        *axis.key,
        F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_r{h}").alias("ret")) for h in hs])).alias("_x"),
    ).select(*axis.key, "_x.*")
    q = exact_quantiles(long, (*axis.key, "horizon"), "ret", {"_q5": 0.05, "_q50": 0.5, "_q95": 0.95}, axis.max_rows)
    now = bars.groupBy(*axis.key).agg(at_last(("close",), axis.order, *axis.tie)[0].alias("_now"))
    out = join_stats(q, now, axis.key)
    return out.select(
        *axis.key, "horizon",
        *[(F.col("_now") * (1 + F.col(f"_q{p}"))).alias(f"p{p}") for p in (5, 50, 95)],
        F.col("_q50").alias("vector"),
    )


# -- ensembles -----------------------------------------------------------------

def ensemble_weighted(predictions: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Weighted mean of the models' predictions per (symbol, ts, horizon); equal weights
    if none are given.  Models without a weight do not take part."""
    if weights is not None:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights are 0 or more")
        w = F.lit(None).cast("double")
        for name, value in weights.items():
            w = F.when(F.col("model_id") == name, F.lit(float(value))).otherwise(w)
        predictions = predictions.withColumn("_w", w).where(F.col("_w").isNotNull())
    else:
        predictions = predictions.withColumn("_w", F.lit(1.0))
    given = F.when(F.col("y_pred").isNotNull(), F.col("_w"))  # a model without a prediction has no say
    return predictions.groupBy("symbol", "ts", "horizon").agg(
        F.try_divide(F.sum(F.col("_w") * F.col("y_pred")), F.sum(given)).alias("y_pred"),
        F.max("y_true").alias("y_true"),
        F.count(given).alias("models"),
    )


def ensemble_stacked(
    predictions: DataFrame, models: Sequence[str], train: float = 0.7, valid: float = 0.1, axis: Axis = Axis()
) -> DataFrame:
    """Level 2: least squares of the actual on the models' predictions, fitted on each
    series' valid rows; predictions for its test rows."""
    cols = {m: f"_p_{i}" for i, m in enumerate(models)}
    wide = predictions.groupBy("symbol", "ts", "horizon").agg(
        *[F.max(F.when(F.col("model_id") == m, F.col("y_pred"))).alias(c) for m, c in cols.items()],
        F.max("y_true").alias("y_true"),
    ).dropna(subset=list(cols.values()))
    parts = split_ordered(wide, train, valid, axis.but(tie=("horizon",)))
    meta = fit_ols(parts.where(F.col("split") == "valid"), list(cols.values()), "y_true", axis.key)
    test = parts.where(F.col("split") == "test")
    return predict_ols(test, meta, list(cols.values()), axis.key).drop("split", *cols.values())
