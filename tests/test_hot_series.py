"""Every query once more with all series cut into blocks of a few dozen rows and all
quantiles taken the way of large groups: the results must not change."""

import importlib
import pkgutil

import pytest

import loomcast
from compare import compare, connect
from loomcast.functions import quantiles, series
from loomcast.suite import load

QUERIES = load()
SMALL = 60


def forced_lay_out(df, axis, lookback=0, lookahead=0):
    return series.lay_out(df, axis.but(max_rows=None, block_rows=SMALL), lookback, lookahead)


def forced_quantiles(df, key, col, probs, max_rows=None, direct_rows=None):
    return quantiles.exact_quantiles(df, key, col, probs, None, 5)


@pytest.fixture(scope="module")
def small_blocks():
    patch = pytest.MonkeyPatch()
    for info in pkgutil.walk_packages(loomcast.__path__, "loomcast."):
        mod = importlib.import_module(info.name)
        if mod in (series, quantiles):
            continue
        if hasattr(mod, "lay_out"):
            patch.setattr(mod, "lay_out", forced_lay_out)
        if hasattr(mod, "exact_quantiles"):
            patch.setattr(mod, "exact_quantiles", forced_quantiles)
    yield
    patch.undo()


AFFECTED = [n for n in QUERIES if n.startswith((
    "ind_", "exp_", "feature", "model_", "prep_", "split_", "latest_s", "ols_", "predict_", "baseline", "interval",
    "ensemble", "eval_c", "mon_", "indicators", "last30", "run_cycle"))]


@pytest.mark.parametrize("name", AFFECTED)
def test_query_in_blocks(spark, sf, small_blocks, name):
    q = QUERIES[name]
    ok, msg = compare(spark, connect(sf), name, q.run, q.sql, sf)
    assert ok, msg
