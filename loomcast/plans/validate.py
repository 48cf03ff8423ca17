"""Rule checks over tables of plans, requests, reports and series: violations as rows.

A broken record is a row of the result, never a failed job.  Record rules are pure
projections (no shuffle); series rules are one map-side combined aggregate.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.functions.expr import mark, violations

# Limits and vocabularies of the plan language.
STRATEGIES = ("mean", "median", "last")
BLOCKS = ("MovingAverage", "ExponentialSmoothing")
INDICATORS = ("SMA", "EMA", "RSI")
BASE_MODELS = ("LSTM", "GRU", "Transformer", "CNN", "TemporalFusionTransformer", "Informer", "Autoformer")
SYMBOL_PATTERN = r"^[A-Z0-9\.\-_]+$"
PLAN_VERSION, DSL_VERSION = "plan_v1", "1.0"
MIN_ROWS, MAX_ROWS = 40, 10_000
MAX_LOOKBACK, MAX_HORIZON, MAX_WINDOW, MAX_TAG = 365, 90, 200, 32
DSL_KEYS = ("version", "symbol", "period", "indicators", "notes")
META_FIELDS = ("plan_id", "run_id", "train_start", "train_end", "predict_horizon", "metrics")
DEFAULTS = {"lookback_days": 30, "horizon_days": 7, "strategy": "mean"}


def _outside(col: str, lo, hi=None) -> Column:
    bad = F.col(col) < lo
    return bad | (F.col(col) > hi) if hi is not None else bad


def _not_in(col: str, names: Sequence[str]) -> Column:
    return ~F.col(col).isin(*names)


def check_baseline(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """lookback_days 1..365 (required), horizon_days 1..90, strategy one of three."""
    return violations(df, ids, [
        mark(F.col("lookback_days").isNull(), "required", "baseline.lookback_days"),
        mark(_outside("lookback_days", 1, MAX_LOOKBACK), "range", "baseline.lookback_days"),
        mark(_outside("horizon_days", 1, MAX_HORIZON), "range", "baseline.horizon_days"),
        mark(_not_in("strategy", STRATEGIES), "enum", "baseline.strategy"),
    ])


def plan_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items()})


def check_plan(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Version, row count and feature blocks (ARRAY<STRUCT<name, window, alpha>>)."""
    blocks = F.coalesce("feature_blocks", F.array().cast(dict(df.dtypes)["feature_blocks"]))
    return violations(df, ids, [
        mark(F.coalesce(F.col("version") != PLAN_VERSION, F.lit(True)), "const", "version"),
        mark(F.col("row_count").isNull(), "required", "row_count"),
        mark(_outside("row_count", MIN_ROWS, MAX_ROWS), "range", "row_count"),
        mark(F.size(blocks) < 1, "minItems", "feature_blocks"),
        mark(F.exists(blocks, lambda b: ~b["name"].isin(*BLOCKS)), "enum", "feature_blocks.name"),
        mark(F.exists(blocks, lambda b: (b["name"] == "MovingAverage") & (
            F.coalesce(b["window"], F.lit(0)) < 1)), "range", "feature_blocks.window"),
        mark(F.exists(blocks, lambda b: (b["name"] == "ExponentialSmoothing") & (
            ~F.coalesce(b["alpha"].between(0.0, 1.0), F.lit(False)))), "range", "feature_blocks.alpha"),
    ])


def _no_date(col: str) -> Column:
    shaped = F.col(col).rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.col(col).isNotNull() & ~(shaped & F.col(col).try_cast("date").isNotNull())


def _only(keys: str, known: Sequence[str], path: str) -> Column:
    """No other keys than the known ones in a map."""
    rest = F.array_except(F.map_keys(keys), F.array(*[F.lit(k) for k in known]))
    return mark(F.size(rest) > 0, "additionalProperties", path)


def check_plan_dsl(df: DataFrame, ids: Sequence[str], extra: str | None = None) -> DataFrame:
    """Flat plans: version, symbol, period of two dates, indicators (ARRAY<STRUCT<name, window>>), all named; in the
    map ``extra`` only the keys of a plan."""
    rules = [_only(extra, DSL_KEYS, "plan")] if extra else []
    return violations(df, ids, [
        *rules,
        mark(_no_date("start"), "format", "period.start"),
        mark(_no_date("end"), "format", "period.end"),
        mark(F.exists("indicators", lambda i: i["name"].isNull()), "required", "indicators.name"),
        mark(F.coalesce(F.col("version") != DSL_VERSION, F.lit(True)), "const", "version"),
        mark(F.col("symbol").isNull(), "required", "symbol"),
        mark(~F.col("symbol").rlike(SYMBOL_PATTERN), "pattern", "symbol"),
        mark(F.col("start").isNull(), "required", "period.start"),
        mark(F.col("end").isNull(), "required", "period.end"),
        mark(F.exists("indicators", lambda i: ~i["name"].isin(*INDICATORS)), "enum", "indicators.name"),
        mark(F.exists("indicators", lambda i: F.coalesce(i["window"], F.lit(5)) < 2), "range", "indicators.window"),
    ])


def check_request(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Run requests: indicator window 1..200, run_no and seq from 1, run_tag up to 32 characters."""
    return violations(df, ids, [
        mark(_outside("run_no", 1), "range", "run_no"),
        mark(_outside("seq", 1), "range", "seq"),
        mark(F.length("run_tag") > MAX_TAG, "maxLength", "run_tag"),
        mark(F.exists("indicators", lambda i: ~i["window"].between(1, MAX_WINDOW)), "range", "indicators.window"),
    ])


def check_run_dsl(df: DataFrame, ids: Sequence[str], overrides: str | None = None) -> DataFrame:
    """Run settings: version, plan_id and run_no required, run_no from 1; in the map
    ``overrides`` only symbol, period and indicators."""
    rules = [
        mark(F.coalesce(F.col("version") != DSL_VERSION, F.lit(True)), "const", "version"),
        mark(F.col("plan_id").isNull(), "required", "plan_id"),
        mark(F.col("run_no").isNull(), "required", "run_no"),
        mark(_outside("run_no", 1), "range", "run_no"),
    ]
    if overrides:
        rest = F.array_except(F.map_keys(overrides), F.array(*[F.lit(k) for k in ("symbol", "period", "indicators")]))
        rules.append(mark(F.size(rest) > 0, "additionalProperties", "overrides"))
    return violations(df, ids, rules)


def check_meta(df: DataFrame, ids: Sequence[str], known: Sequence[str], extra: str | None = None) -> DataFrame:
    """Run meta: its fields are there, so are name and threshold of every metric; thresholds from 0, horizon from 1, no
    unknown keys (in the map ``extra``).  A column that the frame lacks is missing in every row."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None)
    rules = [mark(have(c).isNull(), "required", c) for c in META_FIELDS]
    if "metrics" in df.columns:
        rules.append(mark(F.exists("metrics", lambda m: m["name"].isNull()), "required", "metrics.name"))
        rules.append(mark(F.exists("metrics", lambda m: m["threshold"].isNull()), "required", "metrics.threshold"))
        rules.append(mark(F.exists("metrics", lambda m: m["threshold"] < 0), "range", "metrics.threshold"))
    rules.append(mark(have("predict_horizon").cast("double") < 1, "range", "predict_horizon"))
    if extra:
        rules.append(_only(extra, known, "meta"))
    return violations(df, ids, rules)


def check_reports(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """r2 and threshold within -1..1; the report itself is kept."""
    return violations(df, ids, [
        mark(_outside("r2", -1.0, 1.0), "range", "r2"),
        mark(_outside("threshold", -1.0, 1.0), "range", "threshold"),
    ])


def check_series(bars: DataFrame, key: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """(key..., ts, n) of duplicate times, and of rows without a key or time."""
    n = bars.groupBy(*key, ts).agg(F.count(F.lit(1)).alias("n"))
    lost = F.col(ts).isNull()
    for k in key:
        lost = lost | F.col(k).isNull()
    return n.where((F.col("n") > 1) | lost)


def series_bounds(bars: DataFrame, key: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Row count within bounds per series, and the lookback its span allows (1..365)."""
    span = F.datediff(F.max(F.to_date(ts)), F.min(F.to_date(ts)))
    g = bars.groupBy(*key).agg(F.count(F.lit(1)).alias("row_count"), span.alias("span_days"))
    return g.withColumns({
        "lookback_days": F.least(F.greatest("span_days", F.lit(1)), F.lit(MAX_LOOKBACK)),
        "ok": F.col("row_count").between(MIN_ROWS, MAX_ROWS),
    })


def check_pairs(actual: DataFrame, pred: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that have only an actual or only a prediction.

    One aggregate over both sides: repeated keys are combined before the shuffle.
    """
    both = actual.select(*on, F.lit(1).alias("_a"), F.lit(0).alias("_p")).unionByName(
        pred.select(*on, F.lit(0).alias("_a"), F.lit(1).alias("_p"))
    )
    seen = both.groupBy(*on).agg(F.max("_a").alias("_a"), F.max("_p").alias("_p"))
    one = seen.where(F.col("_a") + F.col("_p") < 2)
    return one.select(*on, F.when(F.col("_a") == 0, "no actual").otherwise("no prediction").alias("rule"))


def check_ensemble(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Ensemble settings: at least two known models, level 1 or 2, weights from 0, one per model."""
    return violations(df, ids, [
        mark(~F.col("level").isin(1, 2), "enum", "level"),
        mark(F.size("base_models") < 2, "minItems", "base_models"),
        mark(F.exists("base_models", lambda m: ~m.isin(*BASE_MODELS)), "enum", "base_models"),
        mark(F.exists("weights", lambda w: w < 0), "range", "weights"),
        mark(F.size("weights") != F.size("base_models"), "length", "weights"),
    ])
