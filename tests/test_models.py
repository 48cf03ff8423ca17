import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomcast.functions.expr import business_calendar, next_weekday, with_next_open
from loomcast.functions.series import DAILY, Axis
from loomcast.operators import models as md
from loomcast.operators import preprocess as pp
from loomcast.operators.check import score_runs
from loomcast.operators.indicators import add_indicators, model_frame


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    out = []
    for s in "ab":
        x = rng.normal(size=(300, 3)) * [1, 100, 0.01] + [5, 1e4, 0]
        y = x @ [2.0, -0.03, 40.0] + 7 + rng.normal(size=300)
        out.append(pd.DataFrame({"symbol": s, "x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 2], "x4": x[:, 0], "y": y}))
    return pd.concat(out), spark.createDataFrame(pd.concat(out)).cache()


@pytest.mark.parametrize("feats", [["x1"], ["x1", "x2", "x3"], ["x1", "x4"], ["x1", "x2", "x3", "x4"]])
def test_ols_matches_least_squares(frame, feats):
    pdf, df = frame
    model = {r.symbol: r for r in md.fit_ols(df, feats, "y").collect()}
    for s, g in pdf.groupby("symbol"):
        m = g[feats].to_numpy()
        c = m - m.mean(axis=0)
        coef = np.linalg.lstsq(c, (g["y"] - g["y"].mean()).to_numpy(), rcond=None)[0]
        want = g["y"].mean() + c @ coef
        got = model[s].intercept + m @ np.array(model[s].coef)
        assert np.allclose(got, want, rtol=1e-8)
        assert np.allclose(model[s].coef, coef, rtol=1e-6)


def test_ols_over_everything(frame):
    _, df = frame
    assert md.fit_ols(df, ["x1"], "y", ()).first().n == 600


def test_in_sample_r2_definitions_agree(frame):
    _, df = frame
    pred = md.predict_ols(df, md.fit_ols(df, ["x1", "x2"], "y"), ["x1", "x2"]).withColumnRenamed("y", "y_true")
    a = {r.symbol: r.r2 for r in score_runs(pred, ["symbol"], "check").collect()}
    b = {r.symbol: r.r2 for r in score_runs(pred, ["symbol"], "corr").collect()}
    assert all(abs(a[s] - b[s]) < 1e-9 for s in a)


def _walk(spark, n=260, seed=1):
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2020-01-01", periods=n)
    out = []
    for i, s in enumerate(("up", "down")):
        # mean-reverting returns, so that there is something to learn
        r = np.zeros(n)
        for k in range(1, n):
            r[k] = -0.8 * r[k - 1] + rng.normal() * 0.01
        c = 50 * (i + 1) * np.exp(np.cumsum(r))
        out.append(pd.DataFrame({"symbol": s, "ts": days.date, "open": c, "high": c * 1.01, "low": c * 0.99, "close": c, "volume": 1.0}))
    return spark.createDataFrame(pd.concat(out))


def test_boosted_trees_beat_the_naive_forecast(spark):
    bars = _walk(spark, 400)
    _, scored = md.train_boosted(bars, iterations=15, lags=(1, 2, 3), windows=(5,))
    s = scored.agg(F.sqrt(F.avg(F.pow(F.col("y_true") - F.col("y_pred"), 2))).alias("m"),
                   F.sqrt(F.avg(F.pow(F.col("y_true") - F.col("close"), 2))).alias("naive")).first()
    assert s.m < s.naive
    with pytest.raises(ValueError, match="huber"):
        md.train_boosted(bars, loss="huber")


def test_boosted_trees_per_split(spark):
    _, whole = md.train_boosted(_walk(spark), iterations=1, lags=(1,), windows=(10,))
    _, per = md.train_boosted(_walk(spark), iterations=1, lags=(1,), windows=(10,), per_split=True)
    assert per.count() < whole.count()


def test_predict_next_uses_the_calendar(spark):
    bars = _walk(spark, 60)
    last = bars.agg(F.max("ts")).first()[0]
    nxt = (pd.Timestamp(last) + pd.offsets.BDay()).date()
    cal = business_calendar(spark, dt.date(2020, 1, 1), dt.date(2021, 1, 1), [nxt])
    plain = md.predict_next(bars, [{"name": "EMA", "window": 9}, {"name": "rsi"}]).collect()
    assert {r.next_day for r in plain} == {nxt}
    held = md.predict_next(bars, [], calendar=cal).collect()
    assert {r.next_day for r in held} == {(pd.Timestamp(nxt) + pd.offsets.BDay()).date()}


def test_business_days_match_pandas(spark):
    days = pd.date_range("2023-12-20", "2024-03-10").date
    hol = [dt.date(2023, 12, 25), dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    df = spark.createDataFrame(pd.DataFrame({"d": days}))
    off = pd.offsets.CustomBusinessDay(holidays=hol)
    cal = business_calendar(spark, days[0], days[-1], hol)
    got = with_next_open(df, "d", cal).withColumn("n", next_weekday("d")).withColumn(
        "n9", md.business_day_after(F.col("d"), F.lit(9)))
    for r in got.collect():
        assert r.next_open == (pd.Timestamp(r.d) + off).date()
        assert r.n == (pd.Timestamp(r.d) + pd.offsets.BDay()).date()
        assert r.n9 == (pd.Timestamp(r.d) + pd.offsets.BDay(9)).date()


def test_calendars_per_market(spark):
    a = business_calendar(spark, dt.date(2024, 1, 1), dt.date(2024, 1, 9), [dt.date(2024, 1, 2)], "jp")
    b = business_calendar(spark, dt.date(2024, 1, 1), dt.date(2024, 1, 9), [], "us")
    df = spark.createDataFrame([("jp", dt.date(2024, 1, 1)), ("us", dt.date(2024, 1, 1))], "market string, d date")
    got = {r.market: r.next_open for r in with_next_open(df, "d", a.unionByName(b)).collect()}
    assert got == {"jp": dt.date(2024, 1, 3), "us": dt.date(2024, 1, 2)}


def test_unknown_indicators_are_errors(spark):
    bars = _walk(spark, 30)
    with pytest.raises(ValueError, match="KST"):
        add_indicators(bars, [{"name": "kst"}])
    with pytest.raises(ValueError, match="unsupported"):
        model_frame(bars, [{"name": "MACD"}])
    with pytest.raises(ValueError, match="parameters"):
        add_indicators(bars, [{"name": "SMA", "length": 3}])


def test_baseline_and_interval_limits(spark):
    bars = _walk(spark, 30)
    with pytest.raises(ValueError):
        md.baseline_forecast(bars, strategy="avg")
    with pytest.raises(ValueError):
        md.interval_forecast(bars, [0, -1])


def test_pca_explains_the_variance(spark):
    bars = _walk(spark, 100)
    out, ratio = pp.pca(bars, ["open", "high", "low", "close"], 2)
    assert {"pc_1", "pc_2"} <= set(out.columns) and ratio[0] > 0.99


def test_preprocess_by_method_names(spark):
    rows = [("s", dt.date(2024, 1, i + 1), None if i == 3 else float(i + 1)) for i in range(9)] + [("s", dt.date(2024, 2, 1), 1e6)]
    df = spark.createDataFrame(rows, "symbol string, ts date, close double")
    cfg = {
        "missing_value_methods": {"enable": "On", "value": ["前日値で補完"]},
        "outlier_methods": {"enable": "On", "value": ["なし", "IQR法"]},
        "scaling_methods": {"enable": "On", "value": ["MinMaxスケーリング"]},
        "feature_generation_methods": {"enable": "Off", "value": ["対数変換"]},
    }
    out = pp.preprocess(df, cfg, axis=DAILY).orderBy("ts").collect()
    assert [r.close for r in out] == [1.0, 2.0, 3.0, 3.0, 5.0, 6.0, 7.0, 8.0, 9.0]
    assert out[0].close_minmax == 0.0 and out[-1].close_minmax == 1.0
    with pytest.raises(ValueError):
        pp.preprocess(df, {"scaling_methods": {"enable": "On", "value": ["?"]}})


def test_statistics_fitted_on_a_part(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(10)], "symbol string, ts int, close double")
    out = pp.min_max(df, fit_on=F.col("ts") < 5).orderBy("ts").collect()
    assert out[4].scaled == 1.0 and out[8].scaled == 2.0
    const = spark.createDataFrame([("s", 1, 4.0), ("s", 2, 4.0)], "symbol string, ts int, close double")
    assert [r.scaled for r in pp.min_max(const, lo=-1.0).collect()] == [-1.0, -1.0]


def test_split_interval_in_blocks(spark):
    bars = _walk(spark, 200)
    small = Axis(block_rows=30)
    one = md.interval_forecast(bars, [1, 5], DAILY).orderBy("symbol", "horizon").collect()
    many = md.interval_forecast(bars, [1, 5], small).orderBy("symbol", "horizon").collect()
    assert all(abs(a.p95 - b.p95) < 1e-9 for a, b in zip(one, many))


@pytest.mark.parametrize("name", ["boosted_forecast", "boosted_record"])
def test_registered_boosted_trees_are_whole(spark, sf, monkeypatch, name):
    """The queries train as many trees on as many features as train_boosted does by itself."""
    import inspect

    from loomcast.suite import load

    kind = inspect.signature(md.train_boosted)

    class Called(Exception):
        pass

    def called(*args, **named):
        bound = kind.bind(*args, **named)
        bound.apply_defaults()
        raise Called(bound.arguments)

    monkeypatch.setattr(md, "train_boosted", called)
    with pytest.raises(Called) as e:
        load()[name].run(spark, sf)
    given = e.value.args[0]
    assert (given["iterations"], given["lags"], given["windows"]) == (100, (1, 2, 3, 5, 10), (5, 10, 20, 60, 120))
