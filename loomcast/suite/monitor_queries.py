"""Operational metrics over counters and gauges derived from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomcast.functions.series import HOURLY
from loomcast.operators import monitor as mn
from loomcast.suite.indicator_queries import W, lag
from loomcast.suite.registry import query
from loomcast.suite.views import ctes

INC = f"""{ctes('samples')}, inc AS (SELECT *, CASE WHEN pv IS NULL THEN NULL WHEN v >= pv THEN v - pv ELSE v END AS inc,
  CASE WHEN pt IS NULL THEN NULL WHEN total >= pt THEN total - pt ELSE total END AS tinc FROM (
  SELECT *, lag(v) OVER w AS pv, lag(ts) OVER w AS pts, lag(total) OVER w AS pt FROM samples WINDOW w AS (PARTITION BY series ORDER BY ts)))"""


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def rate_sql(unit: str, seconds: int, inc: str = "inc") -> str:
    return f"SELECT series, date_trunc('{unit}', ts) AS w, coalesce(sum({inc}), 0) / {seconds}.0 AS rate FROM inc GROUP BY 1, 2"


def counts(t, since=None, until=None):
    return t.samples(since, until).drop("total")


query("mon_rate", ["series", "w"], {"rate": 7}, f"{INC} {rate_sql('minute', 60)}")(lambda t: ntz(mn.rate(counts(t), 60, t.sample_axis()), "w"))
query("mon_irate", ["series", "w"], {"irate": 7}, f"""{INC}, z AS (SELECT *, date_trunc('hour', ts) AS w,
  row_number() OVER (PARTITION BY series, date_trunc('hour', ts) ORDER BY ts DESC) AS d FROM inc)
SELECT series, w, inc / ((epoch_us(ts) - epoch_us(pts)) / 1e6) AS irate FROM z WHERE d = 1 AND pts >= w""")(
    lambda t: ntz(mn.irate(counts(t), 3600, t.sample_axis()), "w"))
query("mon_sum", ["w"], {"sum": 7, "avg": 7}, f"""{INC} SELECT w, sum(rate) AS sum, avg(rate) AS avg
FROM ({rate_sql('hour', 3600)}) GROUP BY w""")(lambda t: ntz(mn.across(mn.rate(counts(t), 3600, t.sample_axis())), "w"))
query("mon_sum_by_le", ["le"], {"cum": 1}, """
SELECT le, CAST(sum(CASE WHEN value <= le THEN 1 ELSE 0 END) AS DOUBLE) AS cum FROM events,
  (VALUES (1.0::DOUBLE), (5.0), (10.0), (50.0), (100.0), (500.0), (1e9)) b(le) GROUP BY le""")(
    lambda t: mn.bucketise(t.read("events"), "value", BOUNDS, ["event_type"]).groupBy("le").agg(F.sum("cum").alias("cum")))
_OKF = """SELECT w, sum(CASE WHEN series = 'purchase' THEN rate ELSE 0 END) AS ok,
  sum(CASE WHEN series = 'error' THEN rate ELSE 0 END) AS failed FROM r GROUP BY w"""
query("mon_ratio", ["w"], {"ok": 7, "failed": 7, "pct": 6}, f"""{INC}, r AS ({rate_sql('hour', 3600)}), p AS ({_OKF})
SELECT *, 100 * (ok / nullif(ok + failed, 0)) AS pct FROM p""")(
    lambda t: ntz(mn.success_ratio(mn.rate(counts(t), 3600, t.sample_axis()), "purchase", "error"), "w"))
query("mon_ratio_clamp", ["w"], {"ok": 7, "failed": 7, "pct": 6}, f"""{INC}, r AS ({rate_sql('hour', 3600)}), p AS ({_OKF})
SELECT *, 100 * ok / greatest(ok + failed, 1) AS pct FROM p""")(
    lambda t: ntz(mn.success_ratio(mn.rate(counts(t), 3600, t.sample_axis()), "purchase", "error", clamp=1), "w"))

BOUNDS = (1.0, 5.0, 10.0, 50.0, 100.0, 500.0, 1e9)
_BUCKETS = """b AS (SELECT CAST(ts AS DATE) AS d, le, CAST(sum(CASE WHEN value <= le THEN 1 ELSE 0 END) AS DOUBLE) AS cum
FROM events, (VALUES (1.0::DOUBLE), (5.0), (10.0), (50.0), (100.0), (500.0), (1e9)) bs(le) GROUP BY 1, 2),
q AS (SELECT *, coalesce(lag(le) OVER (PARTITION BY d ORDER BY le), 0) AS lo, coalesce(lag(cum) OVER (PARTITION BY d ORDER BY le), 0) AS pre,
  max(cum) OVER (PARTITION BY d) AS total FROM b)"""
query("mon_hist_p95", ["d"], {"quantile": 5}, f"""WITH {_BUCKETS}
SELECT d, min_by(CASE WHEN le >= 1e9 THEN lo ELSE lo + (le - lo) * (0.95 * total - pre) / (cum - pre) END, le) AS quantile
FROM q WHERE cum >= 0.95 * total AND total > 0 GROUP BY d""")(
    lambda t: mn.histogram_quantile(
        mn.bucketise(t.read("events"), "value", BOUNDS, [F.to_date("ts").alias("d")]), 0.95, ["d"], top=1e9))
query("mon_mean_runtime", ["series", "w"], {"mean": 7}, f"""{INC}, c AS ({rate_sql('hour', 3600)}), s AS ({rate_sql('hour', 3600, 'tinc')})
SELECT c.series, c.w, s.rate / nullif(c.rate, 0) AS mean FROM c JOIN s ON c.series = s.series AND c.w = s.w""")(
    lambda t: ntz(mn.mean_runtime(t.samples(), "total", "v", 3600, t.sample_axis()), "w"))
query("mon_label_regex", ["event_type", "n"], {}, """
SELECT event_type, count(*) AS n FROM events WHERE regexp_full_match(event_type, '.i.*') GROUP BY event_type""")(
    lambda t: mn.matching(t.read("events"), "event_type", ".i.*").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))
query("mon_label_not_regex", ["event_type", "n"], {}, """
SELECT event_type, count(*) AS n FROM events WHERE NOT regexp_full_match(event_type, 'sign.*|err') GROUP BY event_type""")(
    lambda t: mn.matching(t.read("events"), "event_type", "sign.*|err", negate=True).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n")))
query("mon_gauge_ratio", ["symbol", "ts"], {"used": 6, "share": 6, "gib": 9}, f"""{ctes('bars_hourly')}
SELECT symbol, ts, 100 * (1 - low / nullif(high, 0)) AS used, low / nullif(high, 0) AS share, volume * 1e6 / 1073741824.0 AS gib
FROM bars_hourly""")(
    lambda t: t.bars_hourly().withColumns({
        "used": mn.used_percent("low", "high"), "share": mn.ratio("low", "high"), "gib": mn.gib(F.col("volume") * 1e6)}))
query("mon_cpu_busy", ["w"], {"busy": 6}, f"""{INC}, z AS (SELECT *, date_trunc('hour', ts) AS w,
  row_number() OVER (PARTITION BY series, date_trunc('hour', ts) ORDER BY ts DESC) AS d FROM inc)
SELECT w, 100 - avg(inc / ((epoch_us(ts) - epoch_us(pts)) / 1e6)) * 100 AS busy FROM z WHERE d = 1 AND pts >= w GROUP BY w""")(
    lambda t: ntz(mn.across(mn.irate(counts(t), 3600, t.sample_axis()), col="irate").select("w", mn.busy_percent(F.col("avg")).alias("busy")), "w"))
query("mon_record_15s", ["series", "w_end"], {"value": 6}, f"""{INC}, st AS (
  SELECT series, (epoch_us(ts) // 15000000) * 15 AS s, sum(inc) AS i FROM inc GROUP BY 1, 2)
SELECT series, make_timestamp((s + 15 * k) * 1000000) AS w_end, coalesce(sum(i), 0) / 60 * 60 AS value
FROM st, generate_series(1, 4) g(k) GROUP BY 1, 2""")(lambda t: ntz(mn.sliding_rate(counts(t), axis=t.sample_axis()), "w_end"))
query("mon_alert_hold", ["symbol", "since", "fired_at", "until", "evals"], {}, f"""{ctes('bars_hourly')}, e AS (
  SELECT symbol, ts, close < 30 AS bad, lag(close < 30) OVER ({W}) AS pb, {lag('ts')} AS pts FROM bars_hourly),
i AS (SELECT *, sum(CASE WHEN pb IS NULL OR pb <> bad OR epoch(ts) - epoch(pts) > 3600 THEN 1 ELSE 0 END) OVER ({W}) AS island FROM e)
SELECT symbol, min(ts) AS since, min(ts) + INTERVAL 2 HOUR AS fired_at, max(ts) AS until, count(*) AS evals
FROM i WHERE bad GROUP BY symbol, island HAVING epoch(max(ts)) - epoch(min(ts)) >= 7200""")(
    lambda t: ntz(mn.alert_spans(t.bars_hourly().select("symbol", "ts", (F.col("close") < 30).alias("bad")), 7200, 3600, HOURLY), "fired_at"))


_RULES = [
    {"alert": "ManyErrors", "series": "error", "op": ">", "limit": 3.0, "hold": 3600, "severity": "warning"},
    {"alert": "FewErrors", "series": "error", "op": "<", "limit": 3.0, "hold": 7200, "severity": "info"},
    {"alert": "FewSignups", "series": "signup", "op": "<", "limit": 4.0, "hold": 10800, "severity": "critical"},
]
query("mon_alert_rules", ["alert", "severity", "since", "fired_at", "until", "evals"], {}, f"""{ctes('bars_hourly')}, e AS (
  SELECT alert, severity, hold, ts, CASE WHEN op = '>' THEN volume > lim ELSE volume < lim END AS bad FROM bars_hourly JOIN (VALUES
    ('ManyErrors', 'error', '>', 3.0, 3600, 'warning'), ('FewErrors', 'error', '<', 3.0, 7200, 'info'),
    ('FewSignups', 'signup', '<', 4.0, 10800, 'critical')) r(alert, series, op, lim, hold, severity) ON symbol = series),
l AS (SELECT *, lag(bad) OVER w AS pb, lag(ts) OVER w AS pts FROM e WINDOW w AS (PARTITION BY alert ORDER BY ts)),
i AS (SELECT *, sum(CASE WHEN pb IS NULL OR pb <> bad OR epoch(ts) - epoch(pts) > 3600 THEN 1 ELSE 0 END)
  OVER (PARTITION BY alert ORDER BY ts) AS island FROM l)
SELECT alert, severity, min(ts) AS since, min(ts) + to_seconds(hold) AS fired_at, max(ts) AS until, count(*) AS evals
FROM i WHERE bad GROUP BY alert, severity, hold, island HAVING epoch(max(ts)) - epoch(min(ts)) >= hold""")(
    lambda t: ntz(mn.alert_rules(
        t.bars_hourly().select(F.col("symbol").alias("series"), F.col("ts").alias("at"), F.col("volume").alias("value")),
        3600, _RULES, max_rows=HOURLY.max_rows), "fired_at"))


def _signals(t):
    """Current values of some signals, from the events."""
    def n(kind):
        return F.sum(F.when(F.col("event_type") == kind, 1).otherwise(0))

    agg = t.read("events").agg(
        (100.0 * n("purchase") / (n("purchase") + n("error"))).alias("task_success_rate"),
        n("error").cast("double").alias("task_failed_per_min"),
        F.countDistinct("user_id").cast("double").alias("online_workers"),
        n("signup").cast("double").alias("celery_queue_length"), (n("view") / 1000.0).alias("http_rps"),
        F.max("value").alias("node_cpu_usage"),
    )
    return agg.unpivot([], agg.columns, "name", "value")


_CAT = ", ".join(
    f"('{s['name']}', '{s['unit']}', CAST({'NULL' if s['slo'] is None else s['slo']} AS DOUBLE), '{s['class']}', '{s['direction']}')"
    for s in mn.SIGNALS)
query("mon_slo", ["name", "class", "unit", "ok"], {"value": 5, "slo": 3}, f"""WITH a AS (SELECT
  100.0::DOUBLE * count(*) FILTER (event_type = 'purchase') / count(*) FILTER (event_type IN ('purchase', 'error')) AS r,
  count(*) FILTER (event_type = 'error') AS f, count(DISTINCT user_id) AS u, count(*) FILTER (event_type = 'signup') AS s,
  count(*) FILTER (event_type = 'view') / 1000.0::DOUBLE AS v, max(value) AS m FROM events),
v AS (SELECT 'task_success_rate' AS name, r AS value FROM a UNION ALL SELECT 'task_failed_per_min', f FROM a
  UNION ALL SELECT 'online_workers', u FROM a UNION ALL SELECT 'celery_queue_length', s FROM a
  UNION ALL SELECT 'http_rps', v FROM a UNION ALL SELECT 'node_cpu_usage', m FROM a)
SELECT c.name, class, unit, slo, value, CASE WHEN direction = '>=' THEN value >= slo ELSE value <= slo END AS ok
FROM (VALUES {_CAT}) c(name, unit, slo, class, direction) LEFT JOIN v ON v.name = c.name""")(
    lambda t: mn.slo_status(_signals(t), mn.signal_catalog(t.spark)))
query("mon_instant", ["series", "ts"], {"v": 1}, f"""{ctes('samples')}
SELECT series, max(ts) AS ts, max_by(v, ts) AS v FROM samples GROUP BY series""")(lambda t: mn.instant(counts(t)))
def _range(t):
    """The last 30 days of the samples, every ten minutes."""
    last = t.read("events").agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first()[0] or 0
    end = last // 600 * 600
    start = end - 30 * 86_400
    return ntz(mn.range_query(counts(t, start - 300, end), start, end, 600).withColumnRenamed("at", "at_"), "at_")


query("mon_range", ["series", "at_"], {"v": 1}, f"""{ctes('samples')}, z AS (
  SELECT CAST(floor(epoch(max(ts))) AS BIGINT) // 600 * 600 AS e FROM events), g AS (
  SELECT series, make_timestamp(s * 1000000) AS at_ FROM (SELECT DISTINCT series FROM samples),
    (SELECT unnest(generate_series(e - 30 * 86400, e, 600)) AS s FROM z) gs)
SELECT g.series, at_, v FROM g ASOF JOIN samples s ON g.series = s.series AND s.ts <= g.at_
WHERE s.ts >= at_ - INTERVAL 5 MINUTE""")(_range)
query("heartbeat_gaps", ["user_id", "last_beat", "expected", "missed"], {}, """
SELECT user_id, max(ts) AS last_beat, max(m) - min(m) + 1 AS expected, max(m) - min(m) + 1 - count(DISTINCT m) AS missed
FROM (SELECT *, epoch_us(ts) // 60000000 AS m FROM events) GROUP BY user_id""")(
    lambda t: mn.heartbeat_gaps(t.read("events"), "ts", ["user_id"]))
query("trace_progress", ["run_id", "step", "status", "records"], {"progress": 6}, """
SELECT user_id AS run_id, max_by(event_id % 12, ts) AS step, max_by(event_type, ts) AS status, max(event_id % 12) / 12.0::DOUBLE AS progress,
  count(*) AS records FROM events GROUP BY user_id""")(
    lambda t: mn.trace_progress(t.read("events").select(
        F.col("user_id").alias("run_id"), (F.col("event_id") % 12).alias("step"), F.col("event_type").alias("status"),
        F.col("ts").alias("timestamp")), 12))


def envelopes(events):
    e = F.col("event_id")
    return events.select(
        e.alias("row_id"), F.when(e % 50 != 1, e).alias("event_id"), F.when(e % 40 == 2, "").otherwise(F.col("event_type")).alias("event_type"),
        F.when(e % 30 != 3, F.col("ts")).alias("occurred_at"),
        F.when(e % 20 == 4, F.concat(F.lit("<"), "props")).otherwise(F.col("props")).alias("payload"))


REASON = """CASE WHEN event_id % 50 = 1 THEN 'no event_id' WHEN event_id % 40 = 2 THEN 'no event_type'
  WHEN event_id % 30 = 3 THEN 'no occurred_at' WHEN event_id % 20 = 4 THEN 'bad payload' END"""
query("dead_letter", ["row_id", "reason"], {}, f"""
SELECT event_id AS row_id, {REASON} AS reason FROM events WHERE {REASON} IS NOT NULL""")(
    lambda t: mn.split_envelopes(envelopes(t.read("events")))[1])
query("good_envelopes", ["row_id", "event_type"], {}, f"""
SELECT event_id AS row_id, event_type FROM events WHERE {REASON} IS NULL""")(lambda t: mn.split_envelopes(envelopes(t.read("events")))[0])
