"""Scoring of runs, checks against thresholds, decisions, and the run cycle's joins."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.functions import evaluation as ev
from loomcast.functions.expr import digest_id

RUN = ("plan_id", "run_id")
#: Metrics a check knows, the default accuracy threshold, shards of a run.
SUPPORTED = ("mape", "rmse", "r2")
DEFAULT_THRESHOLD = 0.80
TOTAL_SHARDS = 12

_FAMILIES = {
    "check": (ev.r2_or_zero, ev.mape_plain),
    "calc": (ev.r2_score, ev.mape_finite),
    "guarded": (ev.r2_score, ev.mape_guarded),
    "corr": (ev.r2_corr, ev.mape_plain),
}


def score_columns(family: str, y: str = "y_true", p: str = "y_pred") -> list[Column]:
    r2, mape = _FAMILIES[family]
    return [
        r2(y, p).alias("r2"), ev.mae(y, p).alias("mae"), ev.rmse(y, p).alias("rmse"), mape(y, p).alias("mape"),
        F.count(F.lit(1)).alias("n"),
    ]


def score_runs(predictions: DataFrame, key: Sequence[str] = RUN, family: str = "check") -> DataFrame:
    """{r2, mae, rmse, mape, n} per run: one map-side combined aggregate for all runs."""
    return predictions.groupBy(*key).agg(*score_columns(family))


def score_rollup(predictions: DataFrame, key: Sequence[str], family: str = "check") -> DataFrame:
    """The same with subtotals for each prefix of the key."""
    return predictions.rollup(*key).agg(*score_columns(family))


#: Decimals of reported metrics.
REPORT_DECIMALS = {"r2": 4, "mae": 4, "rmse": 4, "mape": 2}


def rounded_scores(scores: DataFrame) -> DataFrame:
    """Scores as reports show them; checks use the unrounded values."""
    return scores.withColumns({c: F.round(c, d) for c, d in REPORT_DECIMALS.items()})


def long_scores(scores: DataFrame, key: Sequence[str] = RUN) -> DataFrame:
    """(key..., metric, value) for the metrics a check knows."""
    return scores.unpivot(list(key), list(SUPPORTED), "metric", "value")


def metric_checks(scores: DataFrame, meta: DataFrame, key: Sequence[str] = RUN) -> DataFrame:
    """One row per run and threshold it has: passed is value <= threshold, for r2 >=.
    Metrics a check does not know are skipped.  ``meta``: (key..., metric, threshold)."""
    joined = long_scores(scores, key).join(meta, [*key, "metric"])
    passed = F.when(F.col("metric") == "r2", F.col("value") >= F.col("threshold")).otherwise(
        F.col("value") <= F.col("threshold")
    )
    return joined.select(*key, "metric", "value", "threshold", passed.alias("passed"))


def check_report(checks: DataFrame, runs: DataFrame, key: Sequence[str] = RUN) -> DataFrame:
    """One report per run, also for runs without any known metric (those pass)."""
    def r2(col: str) -> Column:
        return F.max(F.when(F.col("metric") == "r2", F.col(col)))

    per_run = checks.groupBy(*key).agg(
        r2("value").alias("_r2"), r2("threshold").alias("_thr"),
        F.bool_and(F.when(F.col("metric") == "r2", F.col("passed"))).alias("_r2_passed"),
        F.bool_and(F.coalesce("passed", F.lit(False))).alias("_all"),
    )
    out = runs.select(*key).distinct().join(per_run, list(key), "left")
    overall = F.coalesce("_all", F.lit(True))
    return out.select(
        *key, digest_id("check_", *key).alias("check_id"),
        F.coalesce("_r2", F.lit(0.0)).alias("r2"), F.coalesce("_thr", F.lit(0.0)).alias("threshold"),
        F.coalesce("_r2_passed", overall).alias("passed"), overall.alias("overall_passed"),
    )


def gate(scores: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """The accuracy flag a finished run carries."""
    return scores.withColumn("threshold", F.lit(float(threshold))).withColumn("passed", F.col("r2") >= threshold)


def report_status(status: Column, passed: Column) -> Column:
    return F.coalesce(status, F.when(passed, "SUCCESS").otherwise("FAILURE"))


def decide(reports: DataFrame, default_threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """(check_id, act_id, action, reason) per report; a missing r2 counts as 0."""
    r2 = F.coalesce("r2", F.lit(0.0))
    thr = F.coalesce("threshold", F.lit(default_threshold))
    ok = r2 >= thr
    return reports.select(
        *[c for c in (*RUN, "check_id") if c in reports.columns],
        digest_id("act-", "check_id").alias("act_id"),
        F.when(ok, "noop").otherwise("retrain").alias("action"),
        F.when(ok, "accuracy within threshold")
        .otherwise(F.format_string("low accuracy (r2=%.3f < %.2f)", r2, thr)).alias("reason"),
    )


def ready_checks(checks: DataFrame, runs: DataFrame, required: Sequence[str] = ("r2", "threshold", "passed")) -> DataFrame:
    """State of each check: READY when its run is DONE and has all required keys in its
    map of results, else WAITING with what is missing."""
    joined = checks.join(runs.select("do_id", F.col("status").alias("_status"), F.col("result").alias("_result")), "do_id", "left")
    have = F.coalesce(F.map_keys("_result"), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), have)
    done = F.coalesce(F.col("_status") == "DONE", F.lit(False))
    return joined.select(
        *checks.columns,
        F.when(done & (F.size(missing) == 0), "READY").otherwise("WAITING").alias("state"),
        F.when(done, F.array_join(missing, ",")).alias("missing"),
    )


def progress(tasks: DataFrame, done: DataFrame, total: int = TOTAL_SHARDS) -> DataFrame:
    """Per run: shards done of the total, and whether it is finished."""
    n = done.select("run_id", "epoch").distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("_d"))
    out = tasks.select("run_id").distinct().join(n, "run_id", "left")
    d = F.coalesce("_d", F.lit(0)).cast("long")
    return out.select(
        "run_id", d.alias("done"), (d / F.lit(total)).alias("progress"),
        F.when(d >= total, "SUCCESS").otherwise("IN_PROGRESS").alias("status"),
    )


def chain(plans: DataFrame, dos: DataFrame, checks: DataFrame, acts: DataFrame) -> DataFrame:
    """plan -> do -> check -> act in one row each; later steps may be missing."""
    return (
        plans.join(dos, "plan_id", "left")
        .join(checks, "do_id", "left")
        .join(acts, "check_id", "left")
        .select("plan_id", "do_id", "check_id", *[c for c in ("status", "r2", "passed", "action", "reason")])
    )


def latest_metrics(run_metrics: DataFrame, by: str = "run_id") -> DataFrame:
    """The record with the largest run id (or the newest, by created_at)."""
    rest = run_metrics.columns
    return run_metrics.agg(F.max_by(F.struct(*rest), F.struct(by, "run_id")).alias("_l")).select("_l.*")


def list_metrics(run_metrics: DataFrame, min_r2: float | None = None) -> DataFrame:
    df = run_metrics if min_r2 is None else run_metrics.where(F.col("r2") >= min_r2)
    return df.orderBy("run_id")


def latest_gauges(run_metrics: DataFrame) -> DataFrame:
    """(gauge, value) of the latest run; missing values read 0."""
    last = latest_metrics(run_metrics)
    return last.select(*[F.coalesce(m, F.lit(0.0)).alias(m) for m in ("r2", "mae", "rmse", "mape")]).unpivot(
        [], ["r2", "mae", "rmse", "mape"], "gauge", "value"
    )
