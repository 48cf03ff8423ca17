"""Boosted trees per series against a plain one worked out split by split."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomcast.functions.series import DAILY
from loomcast.operators import boosting as bo
from loomcast.operators import models as md

FEATURES = ["x1", "x2", "x3"]


def rows(seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for s, n in (("a", 150), ("b", 40), ("c", 6)):
        x = rng.normal(size=(n, 3)).round(2)
        y = np.where(x[:, 0] > 0.3, 2.0, -1.0) * (x[:, 1] + 1.5) + rng.normal(size=n) * 0.2 + 10 * (rng.random(n) < 0.05)
        out.append(pd.DataFrame({"symbol": s, "i": range(n), "x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 2], "y": y}))
    return pd.concat(out, ignore_index=True)


def lower(values, share):
    """The smallest value with at least that share of all at or below it."""
    v = np.sort(values)
    return v[max(int(np.ceil(share * len(v))) - 1, 0)]


def plain(x, y, edges, loss, iterations, depth, step):
    """Boosting of one series with loops; predictions of its own rows."""
    bins = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], 1)
    p = np.full(len(y), y.mean() if loss == "ls" else lower(y, 0.5))
    for _ in range(iterations):
        res = y - p
        width = lower(np.abs(res), bo.UNCLIPPED)
        g = {"ls": res, "lad": np.sign(res), "huber": np.clip(res, -width, width)}[loss]
        node = np.ones(len(y), int)
        for _ in range(depth):
            after = node * 2
            for k in np.unique(node):
                here, best = node == k, None
                for f in range(bins.shape[1]):
                    for b in np.unique(bins[here, f])[:-1]:
                        left = bins[here, f] <= b
                        gl, gr = g[here][left], g[here][~left]
                        gain = (gl.mean() - gr.mean()) ** 2 * len(gl) * len(gr) / here.sum()
                        if gain > 1e-24 and (best is None or gain > best[0] * (1 + 1e-9)):
                            best = gain, f, b
                if best:
                    after[here] += bins[here, best[1]] > best[2]
            node = after
        for k in np.unique(node):
            r = res[node == k]
            m = lower(r, 0.5)
            p[node == k] += step * {"ls": r.mean(), "lad": m, "huber": m + np.clip(r - m, -width, width).mean()}[loss]
    return p


@pytest.mark.parametrize("loss, depth", [("ls", 3), ("lad", 1), ("huber", 2)])
def test_split_by_split(spark, loss, depth):
    data = rows()
    df = spark.createDataFrame(data).repartition(5)
    model = bo.fit_per_series(df, FEATURES, "y", loss=loss, iterations=2, max_depth=depth, step=0.5, bins=8)
    edges = {r.symbol: r.edges for r in model.collect()}
    got = bo.predict_per_series(df, model, FEATURES, max_depth=depth).toPandas().sort_values(["symbol", "i"])
    assert len(got) == len(data) and set(edges) == {"a", "b", "c"}
    for s, part in got.groupby("symbol"):
        x, y = part[FEATURES].to_numpy(), part["y"].to_numpy()
        for i, e in enumerate(edges[s]):
            assert list(e) == list(dict.fromkeys(lower(x[:, i], q / 8) for q in range(1, 8)))
        want = plain(x, y, [np.array(e) for e in edges[s]], loss, 2, depth, 0.5)
        np.testing.assert_allclose(part["y_pred"].to_numpy(), want, rtol=1e-9, atol=1e-9)


def test_one_model_for_each_series(spark):
    rng = np.random.default_rng(2)
    days = pd.bdate_range("2020-01-01", periods=120)
    bars = []
    for i, s in enumerate("ab"):
        c = 50 * (i + 1) * (1 + 0.1 * np.sin(np.arange(120) / 3)) + rng.normal(size=120) * 0.1
        bars.append(pd.DataFrame({"symbol": s, "ts": days.date, "open": c, "high": c + 1, "low": c - 1, "close": c, "volume": 1.0}))
    df = spark.createDataFrame(pd.concat(bars))
    model, scored = md.train_per_series(df, "huber", iterations=3, step=0.8, lags=(1, 2), windows=(5,), axis=DAILY)
    assert {r.symbol: len(r.trees) for r in model.collect()} == {"a": 3, "b": 3}
    got = {r.run_id: r for r in md.train_record(scored, F.col("symbol")).collect()}
    assert set(got) == {"a", "b"} and all(r.r2 > 0.5 and r.rmse >= r.mae > 0 for r in got.values())


def test_odd_rows(spark):
    """Null keys, labels and features, equal labels, single rows, no rows."""
    given = [("a", 1.0, 2.0), ("a", 2.0, 3.0), ("a", None, 9.0), ("a", 3.0, None), ("flat", 1.0, 5.0), ("flat", 2.0, 5.0),
             ("one", 1.0, 7.0), (None, 1.0, 1.0), ("none", None, None)]
    df = spark.createDataFrame(given, "symbol string, x double, y double")
    for loss in ("huber",):
        model = bo.fit_per_series(df, ["x"], "y", loss=loss, iterations=1, max_depth=2, step=1.0, bins=4)
        got = sorted((r.symbol, r.x, r.y_pred) for r in bo.predict_per_series(df.where("x IS NOT NULL"), model, ["x"], max_depth=2).collect())
        assert got == [("a", 1.0, 2.0), ("a", 2.0, 3.0), ("a", 3.0, 3.0), ("flat", 1.0, 5.0), ("flat", 2.0, 5.0), ("one", 1.0, 7.0)]
    nulls = bo.predict_per_series(df.where("symbol = 'a' AND x IS NULL"), model, ["x"], max_depth=2).collect()
    assert [r.y_pred for r in nulls] == [None]
    assert bo.fit_per_series(df.limit(0), ["x"], "y", iterations=1).count() == 0
    with pytest.raises(ValueError, match="loss"):
        bo.fit_per_series(df, ["x"], "y", loss="other")
