"""Physical plans: what is shuffled, what stays out of Python, what fails fast."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomcast.functions.series import DAILY
from loomcast.operators.check import score_runs
from loomcast.operators.features import make_features
from loomcast.operators.indicators import REGISTRY, add_indicators
from loomcast.plans import config as cf
from loomcast.plans import validate as vd
from loomcast.sources.bars import to_bars
from loomcast.suite.views import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_indicators_share_one_shuffle(spark, sf):
    t = Tables(spark, sf)
    bars = t.bars_daily()
    names = [{"name": n} for n in REGISTRY]
    text = plan(add_indicators(bars, names, DAILY))
    # one for the bars' aggregate, one for all windows
    assert text.count("Exchange hashpartitioning") == 2
    assert "Python" not in text and "ArrowEval" not in text


def test_features_and_scores_stay_in_the_jvm(spark, sf):
    t = Tables(spark, sf)
    text = plan(make_features(t.bars_wide(), axis=DAILY))
    assert text.count("Exchange hashpartitioning") == 2 and "Python" not in text
    text = plan(score_runs(t.predictions()))
    assert "partial_avg" in text


def test_bars_read_only_their_columns(spark, sf):
    t = Tables(spark, sf)
    text = plan(to_bars(t.read("lineitem").where(F.col("l_shipdate") >= F.lit(dt.datetime(1998, 1, 1))), F.col("l_suppkey"),
                        F.to_date("l_shipdate"), F.col("l_extendedprice"), F.col("l_orderkey")))
    schema = text.split("ReadSchema")[1]
    assert "l_comment" not in schema and "l_discount" not in schema and "PushedFilters: [IsNotNull(l_shipdate)" in text


def test_market_names(spark):
    m = cf.ticker_map(spark)
    plans = spark.createDataFrame([("p", ["Gold", "nobody", "Nikkei 225"]), ("q", [])], "plan_id string, universe array<string>")
    got = {r.plan_id: r.universe for r in cf.resolve_universe(plans, m).collect()}
    assert got == {"p": ["GC=F", "nobody", "^N225"], "q": []}


def test_overlay_keeps_list_and_subtree_rules(spark):
    defaults = cf.flatten_leaves({"a": {"b": 1, "c": {"d": 2}}, "e": [1, 2], "f": "x", "g": {"h": 1}})
    plan_leaves = cf.flatten_leaves({"a": {"b": 5}, "e": [9], "f": {"deep": 1}, "g": "off"})
    rows = [("p", k, v) for k, v in plan_leaves.items()]
    got = cf.overlay_defaults(spark.createDataFrame(rows, "plan_id string, path string, value string"), defaults).collect()
    assert {r.path: r.value for r in got} == {"a.b": "5", "a.c.d": "2", "e": "[9]", "f.deep": "1", "g": "off"}


def test_plan_rules(spark):
    schema = ("id int, version string, row_count int, "
              "feature_blocks array<struct<name:string,window:int,alpha:double>>")
    df = spark.createDataFrame([
        (1, "plan_v1", 50, [("MovingAverage", 5, None)]),
        (2, "plan_v1", None, [("ExponentialSmoothing", None, 1.5)]),
        (3, None, 39, None),
    ], schema)
    got = {(r.id, r.rule, r.path) for r in vd.check_plan(df, ["id"]).collect()}
    assert got == {(2, "required", "row_count"), (2, "range", "feature_blocks.alpha"), (3, "const", "version"),
                   (3, "range", "row_count"), (3, "minItems", "feature_blocks")}
    base = spark.createDataFrame([(1, None, None, None), (2, 366, 91, "avg")], "id int, lookback_days int, horizon_days int, strategy string")
    assert vd.check_baseline(vd.plan_defaults(base), ["id"]).where("id = 1").count() == 0
    assert vd.check_baseline(base, ["id"]).where("id = 2").count() == 3


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from loomcast import session

    assert session.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")

    class FakeContext:
        master = "yarn"

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        class O:
                            @staticmethod
                            def isDefined():
                                return False
                        return O
                return S

        @staticmethod
        def getConf():
            return {}

    class FakeSession:
        sparkContext = FakeContext
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        monkeypatch.setattr(FakeSession, "conf", type("C", (), {"get": staticmethod(lambda *a: None)}), raising=False)
        session.shared_dir(FakeSession)
