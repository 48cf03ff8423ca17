"""Operational metrics over samples (labels..., ts, v): rates, ratios, quantiles,
recording rules, alerts with a hold time, targets.

Counter steps are computed on the block layout (one metric stream may hold a third of
all samples); everything after it aggregates per time window first, so what is
shuffled is one row per series, window and map task.
Rates divide by the window's length and do not extrapolate to its edges.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcast.functions.expr import anchored, ratio
from loomcast.functions.series import Axis, at_last, lay_out

#: Raw samples: any number per stream, so its length is measured.
SAMPLES = Axis(key=("series",), order="ts")


def increases(samples: DataFrame, axis: Axis = SAMPLES, counters: Mapping[str, str] = {"inc": "v"}) -> DataFrame:
    """A step column per counter (after a reset the new value) and ``prev_ts``; the
    first sample of a stream has none."""
    b = lay_out(samples, axis, 1)
    b = b.add({"prev_ts": b.lag(axis.order), **{f"_p{n}": b.lag(c) for n, c in counters.items()}})
    steps = {
        n: F.when(F.col(f"_p{n}").isNotNull(), F.when(F.col(c) >= F.col(f"_p{n}"), F.col(c) - F.col(f"_p{n}")).otherwise(F.col(c)))
        for n, c in counters.items()
    }
    return b.add(steps).drop(*[f"_p{n}" for n in counters]).rows()


def window_start(ts, seconds: int) -> Column:
    """Start of the fixed window a time lies in, as TIMESTAMP."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_seconds(F.floor(F.unix_micros(c.cast("timestamp")) / (seconds * 1_000_000)) * seconds)


def rate(samples: DataFrame, seconds: int = 60, axis: Axis = SAMPLES) -> DataFrame:
    """(key..., w, rate): per-second increase of each fixed window."""
    inc = increases(samples, axis)
    return inc.groupBy(*axis.key, window_start(axis.order, seconds).alias("w")).agg(
        (F.coalesce(F.sum("inc"), F.lit(0.0)) / seconds).alias("rate")
    )


def irate(samples: DataFrame, seconds: int = 300, axis: Axis = SAMPLES) -> DataFrame:
    """(key..., w, irate): per-second increase between the last two samples of a window."""
    inc = increases(samples, axis).withColumn("w", window_start(axis.order, seconds))
    dt = (F.unix_micros(F.col(axis.order).cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp"))) / 1e6
    last = inc.withColumn("dt", dt).groupBy(*axis.key, "w").agg(*at_last(("inc", "prev_ts", "dt"), axis.order, *axis.tie))
    both = F.col("prev_ts").cast("timestamp") >= F.col("w")
    return last.where(both).select(*axis.key, "w", ratio("inc", "dt").alias("irate"))


def sliding_rate(
    samples: DataFrame, seconds: int = 60, every: int = 15, axis: Axis = SAMPLES, factor: float = 60.0
) -> DataFrame:
    """Recording rule: (key..., w_end, value), the rate of the last ``seconds`` evaluated
    every ``every`` seconds.

    Increases are summed per step first; only those sums are copied to the windows
    they belong to.  The step must divide the window.
    """
    if seconds % every:
        raise ValueError(f"a window of {seconds} s is no multiple of the step of {every} s")
    inc = increases(samples, axis)
    steps = inc.groupBy(*axis.key, window_start(axis.order, every).alias("s")).agg(F.sum("inc").alias("_i"))
    n = seconds // every
    ends = F.sequence(F.unix_seconds("s") + every, F.unix_seconds("s") + every * n, F.lit(every))
    return (
        steps.withColumn("_e", F.explode(ends))
        .groupBy(*axis.key, F.timestamp_seconds("_e").alias("w_end"))
        .agg((F.coalesce(F.sum("_i"), F.lit(0.0)) / seconds * factor).alias("value"))
    )


def across(rates: DataFrame, by: Sequence[str] = ("w",), col: str = "rate") -> DataFrame:
    """sum and avg over the series of each window (or other labels)."""
    return rates.groupBy(*by).agg(F.sum(col).alias("sum"), F.avg(col).alias("avg"))


def pivot_series(df: DataFrame, names: Mapping[str, str], by: Sequence[str] = ("w",), col: str = "rate", series: str = "series") -> DataFrame:
    """One column per listed series; a series without a sample counts 0."""
    return df.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(F.col(series) == s, F.col(col))), F.lit(0.0)).alias(n) for n, s in names.items()]
    )


def success_ratio(rates: DataFrame, ok: str, failed: str, clamp: float | None = None, by: Sequence[str] = ("w",)) -> DataFrame:
    """100·ok/(ok+failed); ``clamp`` is the least denominator (as the success-rate signal
    has it), without it an empty window gives null."""
    p = pivot_series(rates, {"ok": ok, "failed": failed}, by)
    total = F.col("ok") + F.col("failed")
    pct = 100 * F.col("ok") / F.greatest(total, F.lit(float(clamp))) if clamp is not None else 100 * ratio("ok", total)
    return p.select(*by, "ok", "failed", pct.alias("pct"))


def mean_runtime(samples: DataFrame, total: str, count: str, seconds: int = 300, axis: Axis = SAMPLES) -> DataFrame:
    """rate(total)/rate(count) of two counters of the same stream, in one pass."""
    inc = increases(samples, axis, {"_total": total, "_count": count})
    return inc.groupBy(*axis.key, window_start(axis.order, seconds).alias("w")).agg(
        F.try_divide(F.sum("_total"), F.sum("_count")).alias("mean")
    )


def histogram_quantile(buckets: DataFrame, q: float, by: Sequence[str], le: str = "le", cum: str = "cum", top: float | None = None) -> DataFrame:
    """Quantile from cumulative buckets: the first bucket that reaches q·total, linear
    inside it.  ``top`` marks the +Inf bucket, whose lower bound is the answer then.

    A histogram has a handful of buckets, so the window per (by) is bounded by design.
    """
    w = Window.partitionBy(*by).orderBy(le)
    df = buckets.groupBy(*by, le).agg(F.sum(cum).alias("_c"))
    df = df.withColumns({
        "_lo": F.coalesce(F.lag(le).over(w), F.lit(0.0)),
        "_before": F.coalesce(F.lag("_c").over(w), F.lit(0.0)),
        "_total": F.max("_c").over(Window.partitionBy(*by)),
    })
    rank = F.lit(float(q)) * F.col("_total")
    hit = (F.col("_c") >= rank) & (F.col("_total") > 0)
    inside = F.col("_lo") + (F.col(le) - F.col("_lo")) * F.coalesce(
        F.try_divide(rank - F.col("_before"), F.col("_c") - F.col("_before")), F.lit(0.0)
    )
    value = F.when(F.col(le) >= F.lit(float(top)), F.col("_lo")).otherwise(inside) if top is not None else inside
    return df.where(hit).groupBy(*by).agg(F.min_by(value, le).alias("quantile"))


def bucketise(df: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str | Column]) -> DataFrame:
    """Cumulative histogram rows (by..., le, cum) from raw values, without multiplying
    rows: conditional counts per bound, then one short row per bound."""
    agg = df.groupBy(*by).agg(*[
        F.count(F.when(F.col(value) <= b, 1)).cast("double").alias(f"_b{i}") for i, b in enumerate(bounds)
    ])
    keep = [c for c in agg.columns if not c.startswith("_b")]
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("cum")) for i, b in enumerate(bounds)])
    return agg.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.*")


def matching(df: DataFrame, label: str, pattern: str, negate: bool = False) -> DataFrame:
    """Series whose label fully matches a pattern (or does not)."""
    hit = anchored(label, pattern)
    return df.where(~hit if negate else hit)


def used_percent(available: str, total: str) -> Column:
    """100·(1 - available/total)."""
    return 100 * (1 - ratio(available, total))


def busy_percent(idle_rate: Column) -> Column:
    """100 - 100·idle."""
    return 100 - idle_rate * 100


def gib(col) -> Column:
    return (F.col(col) if isinstance(col, str) else col) / (1024.0 * 1024.0 * 1024.0)


# -- alerts and targets --------------------------------------------------------

#: Alert rules (series, comparison, limit, hold in seconds, severity).
ALERTS = (
    {"alert": "HighTaskFailureRate", "series": "task_failed_per_min", "op": ">", "limit": 1.0, "hold": 300, "severity": "warning"},
    {"alert": "QueueBacklog", "series": "queue_backlog_total", "op": ">", "limit": 100.0, "hold": 300, "severity": "warning"},
    {"alert": "WorkersDown", "series": "worker_online", "op": "<", "limit": 1.0, "hold": 60, "severity": "critical"},
)

#: The signal catalog (target None = not judged).
SIGNALS = (
    {"name": "task_success_rate", "unit": "percent", "slo": 99.0, "class": "S", "direction": ">="},
    {"name": "task_failed_per_min", "unit": "ops/min", "slo": 0.0, "class": "S", "direction": "<="},
    {"name": "online_workers", "unit": "count", "slo": 1.0, "class": "S", "direction": ">="},
    {"name": "celery_queue_length", "unit": "count", "slo": 1000.0, "class": "S", "direction": "<="},
    {"name": "task_runtime_p95", "unit": "seconds", "slo": 2.0, "class": "A", "direction": "<="},
    {"name": "http_request_duration_p95", "unit": "seconds", "slo": 0.5, "class": "S", "direction": "<="},
    {"name": "http_5xx_rate", "unit": "ops/s", "slo": 0.0, "class": "S", "direction": "<="},
    {"name": "http_rps", "unit": "ops/s", "slo": None, "class": "A", "direction": "<="},
    {"name": "redis_memory_utilization", "unit": "percent", "slo": 0.9, "class": "A", "direction": "<="},
    {"name": "redis_connected_clients", "unit": "count", "slo": None, "class": "A", "direction": "<="},
    {"name": "postgres_active_connections", "unit": "count", "slo": None, "class": "A", "direction": "<="},
    {"name": "node_cpu_usage", "unit": "percent", "slo": 85.0, "class": "S", "direction": "<="},
    {"name": "node_memory_usage", "unit": "percent", "slo": 90.0, "class": "S", "direction": "<="},
    {"name": "node_disk_io_wait", "unit": "seconds", "slo": None, "class": "A", "direction": "<="},
)


def breached(value: Column, op: str, limit: float) -> Column:
    return value > F.lit(limit) if op == ">" else value < F.lit(limit)


def alert_rules(values: DataFrame, every: int, rules: Sequence[Mapping] = ALERTS, series: str = "series", at: str = "at",
                max_rows: int | None = None) -> DataFrame:
    """Firing spans (alert, severity, since, fired_at, until, evals) of a rule set over
    recorded values (series, at, value).  A value meets only the rules of its series."""
    mine = F.lit(None).cast("array<struct<alert:string,severity:string,hold:int,bad:boolean>>")
    for name in {r["series"] for r in rules}:
        checks = F.array(*[
            F.struct(F.lit(r["alert"]).alias("alert"), F.lit(r["severity"]).alias("severity"),
                     F.lit(r["hold"]).alias("hold"), breached(F.col("value"), r["op"], r["limit"]).alias("bad"))
            for r in rules if r["series"] == name
        ])
        mine = F.when(F.col(series) == name, checks).otherwise(mine)
    evals = values.select(at, F.explode(mine).alias("_r")).select(at, "_r.*")
    axis = Axis(key=("alert", "severity", "hold"), order=at, max_rows=max_rows)
    return alert_spans(evals, F.col("hold"), every, axis).drop("hold")


def alert_spans(evals: DataFrame, hold: int | Column, every: int, axis: Axis) -> DataFrame:
    """Firing spans (key..., since, fired_at, until, evals) of a condition that held for
    at least ``hold`` seconds (a number or a key column) without a break.

    ``evals``: (key..., time, bad BOOLEAN), one row per evaluation.  A missing evaluation
    (a gap of more than ``every`` seconds) ends a span.  Consecutive bad rows get one
    island number, a running count of the breaks, carried over the blocks of a series.
    """
    b = lay_out(evals, axis, 1)
    sec = F.unix_seconds(F.col(axis.order).cast("timestamp"))
    b = b.add({"_pb": b.lag("bad"), "_ps": b.lag(sec), "_s": sec})
    new = F.col("_pb").isNull() | (F.col("_pb") != F.col("bad")) | (F.col("_s") - F.col("_ps") > every)
    b = b.running_sum({"_island": F.when(new, F.lit(1)).otherwise(F.lit(0))})
    spans = b.rows().where("bad").groupBy(*axis.key, "_island").agg(
        F.min(axis.order).alias("since"), F.max(axis.order).alias("until"), F.count(F.lit(1)).alias("evals"),
        (F.max("_s") - F.min("_s")).alias("_len"),
    )
    fired = F.timestamp_seconds(F.unix_seconds(F.col("since").cast("timestamp")) + hold)
    return spans.where(F.col("_len") >= hold).select(*axis.key, "since", fired.alias("fired_at"), "until", "evals")


def slo_status(values: DataFrame, catalog: DataFrame) -> DataFrame:
    """(name, class, unit, value, slo, ok) of current values; without a target ok is null."""
    v = values.select(F.col("name").alias("_n"), "value")
    out = catalog.join(v, F.col("name") == F.col("_n"), "left").drop("_n")
    ok = F.when(F.col("direction") == ">=", F.col("value") >= F.col("slo")).otherwise(F.col("value") <= F.col("slo"))
    return out.select("name", "class", "unit", "value", "slo", ok.alias("ok"))


def signal_catalog(spark) -> DataFrame:
    schema = "name string, unit string, slo double, class string, direction string"
    return spark.createDataFrame([tuple(s.values()) for s in SIGNALS], schema)


# -- queries over samples --------------------------------------------------------

def instant(samples: DataFrame, axis: Axis = SAMPLES) -> DataFrame:
    """Latest value per series."""
    return samples.groupBy(*axis.key).agg(*at_last(("v",), axis.order, *axis.tie), F.max(axis.order).alias("ts"))


def range_query(
    samples: DataFrame, start: int, end: int, step: int, axis: Axis = SAMPLES, stale: int = 300
) -> DataFrame:
    """(key..., at, v): last sample at most ``stale`` seconds old at each step of
    [start, end] (epoch seconds); steps without one are left out.

    Samples reach at most the steps of the following ``stale`` seconds, so each is first
    reduced to the last one per step interval, then copied to the steps it may serve:
    an equi-grouping, no range join and no fill over a whole series.
    """
    t = F.unix_micros(F.col(axis.order).cast("timestamp")) / 1e6
    first_step = F.greatest(F.ceil((t - F.lit(start)) / step), F.lit(0)).cast("long")
    # the raw column is compared, in its own type, so that the bounds reach the files
    bounds = [F.timestamp_seconds(F.lit(x)).cast(samples.schema[axis.order].dataType) for x in (start - stale, end)]
    last = (
        samples.where(F.col(axis.order).between(*bounds))
        .withColumn("_t", t)
        .groupBy(*axis.key, first_step.alias("_k"))
        .agg(*at_last(("v", "_t"), axis.order, *axis.tie))
    )
    lasting = F.floor((F.col("_t") + stale - start) / step).cast("long")
    upto = F.least(lasting, F.lit((end - start) // step))
    steps = last.where(upto >= F.col("_k")).withColumn("_at", F.explode(F.sequence("_k", upto)))
    return steps.groupBy(*axis.key, F.timestamp_seconds(F.lit(start) + F.col("_at") * step).alias("at")).agg(
        F.max_by("v", "_t").alias("v")
    )


def heartbeat_gaps(beats: DataFrame, ts: str, key: Sequence[str], every: int = 60) -> DataFrame:
    """Per source: last beat, beats expected and missed between its first and last.

    Beats are reduced to distinct minutes; how many are missing is then a count.
    """
    minute = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (every * 1_000_000))
    seen = beats.select(*key, ts, minute.alias("_m")).groupBy(*key, "_m").agg(F.max(ts).alias("_t"))
    return seen.groupBy(*key).agg(
        F.max("_t").alias("last_beat"),
        (F.max("_m") - F.min("_m") + 1).alias("expected"),
        (F.max("_m") - F.min("_m") + 1 - F.count(F.lit(1))).alias("missed"),
    )


def trace_progress(trace: DataFrame, total: int) -> DataFrame:
    """Latest step and status per run, and the share of the steps reached."""
    return trace.groupBy("run_id").agg(
        F.max_by("step", "timestamp").alias("step"), F.max_by("status", "timestamp").alias("status"),
        (F.max("step") / F.lit(total)).alias("progress"), F.count(F.lit(1)).alias("records"),
    )


def split_envelopes(events: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Valid event envelopes, and the dead letters with a reason; nothing fails."""
    parsed = F.try_parse_json(payload)
    reason = (
        F.when(F.col("event_id").isNull(), "no event_id")
        .when(F.coalesce(F.length("event_type"), F.lit(0)) == 0, "no event_type")
        .when(F.col("occurred_at").isNull(), "no occurred_at")
        .when(parsed.isNull(), "bad payload")
    )
    marked = events.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())
