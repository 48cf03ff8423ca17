"""Block layout against pandas: the same values whether a series is one block or many."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomcast.functions.quantiles import exact_quantiles
from loomcast.functions.series import DAILY, Axis, lay_out
from loomcast.operators.features import exponential_smoothing, make_features, split_ordered
from loomcast.operators.indicators import REGISTRY, add_indicators, column_names
from loomcast.operators.preprocess import fill_previous

ONE = DAILY
#: many small blocks of uneven slices; 'hot' holds most rows
MANY = DAILY.but(max_rows=None, block_rows=40, slice_seconds=9 * 86_400)


def _bars(seed=3, sizes=(("hot", 700), ("b", 61), ("c", 1))):
    rng = np.random.default_rng(seed)
    out = []
    for sym, n in sizes:
        days = np.sort(rng.choice(np.arange(3 * n + 5), size=n, replace=False))
        close = 100 + np.cumsum(rng.normal(size=n))
        high, low = close + rng.random(n), close - rng.random(n)
        out.append(pd.DataFrame({
            "symbol": sym, "ts": (pd.Timestamp("2010-01-01") + pd.to_timedelta(days, "D")).date,
            "open": close, "high": high, "low": low, "close": close, "volume": rng.integers(1, 99, n) * 1.0,
        }))
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="module")
def pdf():
    return _bars()


@pytest.fixture(scope="module")
def bars(spark, pdf):
    return spark.createDataFrame(pdf).repartition(5).cache()


def by_key(df):
    return df.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


def per_symbol(pdf, fn):
    return pd.concat([fn(g) for _, g in pdf.sort_values(["symbol", "ts"]).groupby("symbol")]).reset_index(drop=True)


def close_to(a, b, tol=1e-9):
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    assert a.shape == b.shape
    assert np.array_equal(np.isnan(a), np.isnan(b))
    assert np.allclose(a, b, rtol=tol, atol=tol, equal_nan=True)


def test_layout_really_splits(bars):
    b = lay_out(bars, MANY, 15, 3)
    assert b.split
    own = b.own().df
    assert own.count() == bars.count()
    sizes = own.groupBy("symbol", "_blk").count().toPandas()
    assert sizes["count"].max() < 60 and len(sizes) > 10


def test_slices_adapt_to_crowded_times(spark):
    """Nearly all rows lie in a thousandth of the time span."""
    x = np.concatenate([np.arange(5000) * 1e-3, [10_000.0, 20_000.0]])
    df = spark.createDataFrame(pd.DataFrame({"symbol": "s", "ts": x, "close": x}))
    b = lay_out(df, Axis(block_rows=100), 7)
    sizes = b.own().df.groupBy("_blk").count().toPandas()["count"]
    assert sizes.max() <= 200 and len(sizes) > 30
    got = b.add({"m": b.roll(F.avg, "close", 8)}).rows().orderBy("ts").toPandas()
    close_to(got["m"], pd.Series(x).rolling(8).mean())


@pytest.mark.parametrize("axis", [ONE, MANY], ids=["one", "many"])
def test_rolling_and_ema_match_pandas(bars, pdf, axis):
    got = by_key(add_indicators(bars, [
        {"name": "sma", "window": 5}, {"name": "EMA", "window": 9}, {"name": "RSI", "window": 14},
        {"name": "std", "window": 20}, {"name": "DEMA", "window": 7}, {"name": "SMA", "window": 5},
    ], axis))
    close_to(got["SMA_5"], per_symbol(pdf, lambda g: g["close"].rolling(5, min_periods=5).mean()))
    close_to(got["EMA_9"], per_symbol(pdf, lambda g: g["close"].ewm(span=9, adjust=False).mean()))
    close_to(got["STD_20"], per_symbol(pdf, lambda g: g["close"].rolling(20, min_periods=20).std()))

    def dema(g):
        e = g["close"].ewm(span=7, adjust=False).mean()
        return 2 * e - e.ewm(span=7, adjust=False).mean()

    def rsi(g):
        d = g["close"].diff()
        gain = d.clip(lower=0).rolling(14, min_periods=14).mean()
        loss = (-d.clip(upper=0)).rolling(14, min_periods=14).mean()
        return 100 - 100 / (1 + gain / loss.replace(0, 1e-9))

    close_to(got["DEMA_7"], per_symbol(pdf, dema))
    close_to(got["RSI_14"], per_symbol(pdf, rsi))


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_indicator_is_the_same_in_blocks(bars, name):
    cols = list(column_names(name, {}))
    one = by_key(add_indicators(bars, [{"name": name}], ONE))
    many = by_key(add_indicators(bars, [{"name": name}], MANY))
    assert one[cols].notna().any().all()
    close_to(one[cols], many[cols])


@pytest.mark.parametrize("alpha", [0.0, 1e-3, 0.2, 0.9, 0.9999, 1.0])
@pytest.mark.parametrize("adjust", [False, True])
def test_exponential_smoothing(bars, pdf, alpha, adjust):
    axis = ONE if alpha in (1e-3,) else MANY
    got = by_key(exponential_smoothing(bars, alpha, adjust, axis))
    if alpha == 0.0:
        want = per_symbol(pdf, lambda g: g["close"].expanding().mean() if adjust else g["close"] * 0 + g["close"].iloc[0])
    else:
        want = per_symbol(pdf, lambda g: g["close"].ewm(alpha=alpha, adjust=adjust).mean())
    close_to(got["smooth"], want)


def test_long_series_ema_with_many_leaves(spark):
    n = 20_000
    rng = np.random.default_rng(0)
    x = np.where(rng.random(n) < 0.01, 1e9, rng.normal(size=n))
    df = spark.createDataFrame(pd.DataFrame({"symbol": "s", "ts": np.arange(n), "close": x}))
    axis = Axis(block_rows=3000)
    for alpha in (0.6, 0.05):
        b = lay_out(df, axis)
        got = b.ema({"e": ("close", alpha)}).rows().orderBy("ts").toPandas()
        close_to(got["e"], pd.Series(x).ewm(alpha=alpha, adjust=False).mean(), 1e-8)


def test_sparse_values_give_the_same_averages_in_blocks_of_any_size(spark):
    n = 2000
    rng = np.random.default_rng(7)
    x = np.where(np.arange(n) % 40 == 13, rng.normal(10, 2, n), np.nan)
    x[:100] = np.nan  # the first blocks hold no value at all
    close = [None if np.isnan(v) else float(v) for v in x]
    bars = spark.createDataFrame(
        [("s", i, c, None if c is None else c + 1, None if c is None else c - 1) for i, c in enumerate(close)],
        "symbol string, ts long, close double, high double, low double",
    )
    cfg = [{"name": "EMA", "window": 9}, {"name": "TEMA", "window": 5}, {"name": "MACD"}, {"name": "ATR"}]
    want = None
    for rows in (5000, 120, 31):
        got = add_indicators(bars, cfg, Axis(block_rows=rows)).orderBy("ts").toPandas()
        ema = pd.Series(x).ewm(span=9, adjust=False, ignore_na=True).mean()
        close_to(got["EMA_9"], ema)
        want = got if want is None else want
        for c in set(got.columns) - {"symbol"}:
            close_to(got[c], want[c])


def test_fixed_weights_skip_null_values(spark):
    rows = [("a", 1, None), ("a", 2, 10.0), ("a", 3, 20.0), ("b", 1, 5.0), ("b", 2, None), ("c", 1, None)]
    df = spark.createDataFrame(rows, "symbol string, ts long, close double")
    got = {(r["symbol"], r["ts"]): r["smooth"] for r in exponential_smoothing(df, 0.0).collect()}
    assert got == {("a", 1): None, ("a", 2): 10.0, ("a", 3): 10.0, ("b", 1): 5.0, ("b", 2): 5.0, ("c", 1): None}


@pytest.mark.parametrize("axis", [ONE, MANY], ids=["one", "many"])
def test_features(bars, pdf, axis):
    got = by_key(make_features(bars, (1, 2, 10), (5, 20), axis))

    def feats(g):
        c = g["close"]
        x = pd.DataFrame({"lag_10": c.shift(10), "vol_20": c.rolling(20).std(), "returns_5d": c.pct_change(5),
                          "target": c.shift(-1)})
        return x.dropna()

    want = per_symbol(pdf, feats)
    close_to(got[["lag_10", "vol_20", "returns_5d", "target"]], want)


@pytest.mark.parametrize("axis", [ONE, MANY], ids=["one", "many"])
def test_split_truncates_like_float64(bars, pdf, axis):
    got = split_ordered(bars, 0.7, 0.1, axis).groupBy("symbol", "split").count().toPandas()
    got = {(r.symbol, r.split): r["count"] for _, r in got.iterrows()}
    for sym, n in (("hot", 700), ("b", 61)):
        assert got[(sym, "train")] == int(n * 0.7)
        assert got[(sym, "valid")] == int(n * 0.1)
    assert got[("c", "test")] == 1


@pytest.mark.parametrize("axis", [ONE, MANY], ids=["one", "many"])
def test_fill_previous_over_blocks(bars, pdf, axis):
    gappy = bars.withColumn("close", F.when(F.pmod(F.xxhash64("ts"), F.lit(3)) == 0, F.col("close")))
    src = by_key(gappy)
    got = by_key(fill_previous(gappy, "close", axis))
    close_to(got["close"], src.groupby("symbol")["close"].ffill())


def test_exact_quantiles_of_large_groups(spark, bars, pdf):
    probs = {"a": 0.05, "m": 0.5, "z": 0.95, "lo": 0.0, "hi": 1.0}
    want = exact_quantiles(bars, ("symbol",), "close", probs).toPandas().set_index("symbol").sort_index()
    got = exact_quantiles(bars, ("symbol",), "close", probs, direct_rows=10).toPandas().set_index("symbol").sort_index()
    close_to(got[list(probs)], want[list(probs)])
    ties = spark.range(50_000).select(F.lit("s").alias("symbol"), (F.col("id") % 7).cast("double").alias("close"))
    row = exact_quantiles(ties, ("symbol",), "close", probs, direct_rows=10).first()
    assert (row.a, row.m, row.z, row.lo, row.hi) == (0.0, 3.0, 6.0, 0.0, 6.0)
    big = spark.range(60_000).select(F.lit("s").alias("symbol"), F.pow(F.col("id"), 2).cast("double").alias("close"))
    one = exact_quantiles(big, ("symbol",), "close", probs).first()
    two = exact_quantiles(big, ("symbol",), "close", probs, direct_rows=10).first()
    close_to(list(one)[1:], list(two)[1:])


@pytest.mark.parametrize("n", [1, 2, 258, 9_999, 10_001, 12_345, 47_000])
def test_exact_quantiles_at_many_sizes(spark, n):
    df = spark.range(n).select(F.lit("s").alias("symbol"), F.randn(7).alias("close")).repartition(4)
    probs = {f"p{i}": p for i, p in enumerate((0.0002, 0.01, 0.25, 0.5, 0.777, 0.9999))}
    one = exact_quantiles(df, ("symbol",), "close", probs).first()
    two = exact_quantiles(df, ("symbol",), "close", probs, direct_rows=0).first()
    close_to(list(one)[1:], list(two)[1:])


def _smoothed(values, alpha, adjust):
    """Reference: nulls are skipped and carry the last average."""
    out, e, num, den = [], None, 0.0, 0.0
    for x in values:
        if x is not None:
            if adjust:
                num, den = num * (1 - alpha) + x, den * (1 - alpha) + 1
                e = num / den
            else:
                e = x if e is None else (1 - alpha) * e + alpha * x
        out.append(e)
    return out


@pytest.mark.parametrize("block", [120, 1_000_000])
@pytest.mark.parametrize("alpha,adjust", [(0.5, False), (0.2, False), (0.5, True), (0.2, True), (0.0, True)])
def test_smoothing_over_null_runs(spark, alpha, adjust, block):
    """Sparse values and null runs longer than a block give the same averages in one block and in many."""
    import datetime as dt
    import random

    rnd = random.Random(4)
    values = [rnd.uniform(1, 100) if i % 7 == 3 or i > 1600 else None for i in range(2000)]
    values[300:900] = [None] * 600
    day = dt.date(2000, 1, 1)
    rows = [("s", day + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    bars = spark.createDataFrame(rows, "symbol string, ts date, close double")
    axis = Axis(block_rows=block)
    got = {r.ts: r.smooth for r in exponential_smoothing(bars, alpha, adjust, axis).collect()}
    want = _smoothed(values, alpha, adjust) if alpha else []
    if not alpha:
        known = []
        for v in values:
            known += [v] if v is not None else []
            want.append(sum(known) / len(known) if known else None)
    assert len(got) == 2000
    for (_, t, _), w in zip(rows, want):
        assert (got[t] is None) == (w is None) and (w is None or abs(got[t] - w) < 1e-9), (t, got[t], w)
