"""Streams over the events file; what a finished run must give is plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomcast.functions.series import settle
from loomcast.operators import monitor as mn
from loomcast.operators.monitor import split_envelopes
from loomcast.session import scratch

from loomcast.sources import artifacts as ar
from loomcast.sources import documents as dc
from loomcast.streaming import jobs as st
from loomcast.suite.monitor_queries import REASON, envelopes
from loomcast.suite.registry import query
from loomcast.suite.views import ctes


def raw(t):
    return st.read_stream(t.spark, files(t), t.read("events").schema)


def files(t):
    """The events table as a stream source: a pattern, as it may be one file or a folder."""
    return t.path("events")[:-1] + "[t]"


def stream(t):
    """The events as a file stream; the watermark allows an hour of delay."""
    return st.event_time(raw(t), "ts", "1 hour")


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def _tumbling(t):
    w = st.windowed(stream(t), "ts", ["event_type"], "1 hour", n=F.count(F.lit(1)), total=F.sum("value"))
    return ntz(st.latest_per_key(st.run_available(w, "update", "tumbling"), ["event_type", "w_start"]), "w_start")


query("stream_tumbling", ["event_type", "w_start", "n"], {"total": 4}, """
SELECT event_type, date_trunc('hour', ts) AS w_start, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2""")(_tumbling)


def _sliding(t):
    w = st.windowed(stream(t), "ts", ["event_type"], "1 hour", "15 minutes", n=F.count(F.lit(1)))
    return ntz(st.latest_per_key(st.run_available(w, "update", "sliding"), ["event_type", "w_start"]), "w_start")


query("stream_sliding", ["event_type", "w_start", "n"], {}, """
SELECT event_type, make_timestamp(((epoch_us(ts) // 900000000) - k) * 900000000) AS w_start, count(*) AS n
FROM events, generate_series(0, 3) g(k) GROUP BY 1, 2""")(_sliding)


def _sessions(t):
    s = st.sessions(stream(t), "ts", ["user_id"], "2 hours", n=F.count(F.lit(1)))
    return ntz(st.run_available(s, "append", "sessions"), "s_start", "s_end")


query("stream_session", ["user_id", "s_start", "s_end", "n"], {}, """
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM g)
SELECT user_id, min(ts) AS s_start, max(ts) + INTERVAL 2 HOUR AS s_end, count(*) AS n FROM i GROUP BY user_id, island
HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""")(_sessions)


def _dedup(t):
    twice = stream(t).union(stream(t))
    return st.run_available(st.deduplicated(twice, ["event_id"]), "append", "dedup")


query("stream_dedup", ["event_id", "event_type"], {"value": 2}, "SELECT event_id, event_type, value FROM events")(_dedup)


def _outbox(t):
    """Every event arrives twice in one batch."""
    s = raw(t)
    return t.spark.read.parquet(st.write_once(s.union(s), ["event_id"], scratch(t.spark, "outbox")))


query("stream_outbox", ["event_id", "event_type", "props"], {"value": 2},
      "SELECT event_id, event_type, props, value FROM events")(_outbox)


def _alerts(t):
    """Record the hourly means, then hold alerts over the recorded series."""
    w = st.windowed(stream(t), "ts", ["event_type"], "1 hour", mean=F.avg("value"))
    rules = w.select(F.col("event_type").alias("series"), F.col("w_start").alias("at"), (F.col("mean") < 40).alias("bad"))
    folder = scratch(t.spark, "recorded")
    st.run_available(rules, "append", folder=folder)
    fired = st.hold_alerts(st.recorded(t.spark, folder, rules.schema), 7200, 3600)
    return ntz(fired.where("state = 'FIRING'"), "since", "fired_at")


query("stream_alert_hold", ["series", "since", "fired_at"], {}, """
WITH h AS (SELECT event_type AS series, date_trunc('hour', ts) AS at_, avg(value) < 40 AS bad FROM events GROUP BY 1, 2
  HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)),
e AS (SELECT *, lag(bad) OVER w AS pb, lag(at_) OVER w AS pt FROM h WINDOW w AS (PARTITION BY series ORDER BY at_)),
i AS (SELECT *, sum(CASE WHEN pb IS NULL OR pb <> bad OR at_ - pt > INTERVAL 1 HOUR THEN 1 ELSE 0 END)
  OVER (PARTITION BY series ORDER BY at_) AS island FROM e)
SELECT series, min(at_) AS since, min(at_) + INTERVAL 2 HOUR AS fired_at FROM i WHERE bad GROUP BY series, island
HAVING max(at_) - min(at_) >= INTERVAL 2 HOUR""")(_alerts)


def _ready(t):
    checks = stream(t).where("event_type = 'signup'").select(
        F.col("event_id").alias("check_id"), F.col("user_id").alias("do_id"), F.col("ts").alias("check_at"))
    runs = stream(t).where("event_type IN ('purchase', 'error')").select(
        F.col("event_id").alias("run_event"), F.col("user_id").alias("run_do_id"), F.col("ts").alias("done_at"),
        F.when(F.col("event_type") == "purchase", "DONE").otherwise("FAILED").alias("status"))
    return st.run_available(st.ready_stream(checks, runs, "3 hours"), "append", "ready")


query("stream_check_ready", ["check_id", "do_id", "run_event"], {}, """
SELECT c.event_id AS check_id, c.user_id AS do_id, r.event_id AS run_event FROM events c JOIN events r ON c.user_id = r.user_id
WHERE c.event_type = 'signup' AND r.event_type = 'purchase' AND r.ts BETWEEN c.ts - INTERVAL 3 HOUR AND c.ts + INTERVAL 3 HOUR""")(_ready)


def _follow(t):
    s = stream(t).select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").alias("k"))
    return ntz(st.run_available(s, "append", "follow"), "ts")


query("stream_follow", ["event_id", "user_id", "ts", "k"], {}, """
SELECT event_id, user_id, ts, regexp_extract(props, '"k": *([0-9]+)', 1) AS k FROM events""")(_follow)


CUT = "2024-01-15"


def _tail_follow(t):
    """The last 20 entries per user of the log so far, then what the stream adds."""
    log = t.read("events").where(F.col("ts") < F.lit(CUT).cast("timestamp_ntz"))
    tail = settle(dc.tail(log, 20, ("user_id",), "event_id").select("user_id", "event_id"))
    new = st.run_available(st.follow_after(tail, stream(t).select("user_id", "event_id"), "user_id", "event_id"), "append", "tail")
    return tail.unionByName(new.select("user_id", "event_id"))


query("stream_tail_follow", ["user_id", "event_id"], {}, f"""
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS d FROM events
  WHERE ts < TIMESTAMP '{CUT}') WHERE d <= 20
UNION ALL SELECT user_id, event_id FROM events e WHERE event_id > coalesce(
  (SELECT max(event_id) FROM events o WHERE o.user_id = e.user_id AND o.ts < TIMESTAMP '{CUT}'), -1)""")(_tail_follow)


def _refresh(t):
    """Hourly bars refreshed in two scheduled calls on one state folder; the second call
    finds nothing new, so the answer is that of the batch job."""
    state = scratch(t.spark, "refresh")
    schema = t.read("events").schema

    def job(df):
        w = st.windowed(st.event_time(df, "ts", "1 hour"), "ts", ["event_type"], "1 hour",
                        high=F.max("value"), low=F.min("value"))
        return w

    for _ in range(2):
        out = st.incremental(t.spark, files(t), schema, job, state)
    return ntz(out, "w_start")


query("stream_incremental", ["event_type", "w_start"], {"high": 2, "low": 2}, """
SELECT event_type, date_trunc('hour', ts) AS w_start, max(value) AS high, min(value) AS low FROM events GROUP BY 1, 2
HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""")(_refresh)


def _routed(t):
    incoming = raw(t)
    good, dead = st.route(envelopes(incoming), split_envelopes, scratch(t.spark, "routed"))
    rows = [t.spark.read.parquet(p).select("row_id", F.lit(n).alias("outcome")) for n, p in (("good", good), ("dead", dead))]
    return rows[0].unionByName(rows[1])


query("stream_dead_letter", ["row_id", "outcome"], {}, f"""
SELECT event_id AS row_id, CASE WHEN {REASON} IS NULL THEN 'good' ELSE 'dead' END AS outcome FROM events""")(_routed)


def _forecast(t):
    """Daily bars arrive in three parts, each followed by a refresh; the forecast is that of one fit on all of them."""
    bars = t.bars_daily().select("symbol", "ts", "close")
    low, high = bars.agg(F.min("ts"), F.max("ts")).first()
    src, state = scratch(t.spark, "bars"), scratch(t.spark, "trend")
    third, moments, x = F.expr(f"datediff(ts, DATE'{low}') * 3 div {(high - low).days + 1}") if low else F.lit(0), None, F.unix_date("ts")
    for part in range(3):
        bars.where(third == part).write.mode("append").parquet(src)
        moments = st.refresh_trend(st.read_stream(t.spark, src, bars.schema), x, F.col("close"), ["symbol"], state)
    return st.trend_forecast(moments, 1, ["symbol"])


query("forecast_refreshed", ["symbol", "n"], {"slope": 6, "forecast": 3}, f"""{ctes('bars_daily')}
SELECT symbol, count(*) AS n, regr_slope(close, x) AS slope, regr_intercept(close, x) + regr_slope(close, x) * (max(x) + 1) AS forecast
FROM (SELECT symbol, close, CAST(ts - DATE '1970-01-01' AS DOUBLE) AS x FROM bars_daily) b GROUP BY symbol""")(_forecast)


def _trace_stream(t):
    """Records as JSON lines with planted bad ones: cut off, not JSON, blank, without a run."""
    folder, out = scratch(t.spark, "trace"), scratch(t.spark, "trace_routed")
    record = t.read("events").select(
        F.to_json(F.struct(F.col("user_id").cast("string").alias("run_id"), (F.col("event_id") % 12).cast("int").alias("step"),
                           F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("timestamp"),
                           F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("details")),
                  {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value"), "event_id")
    kind = F.col("event_id") % 50
    planted = record.select(F.explode(F.array_compact(F.array(
        "value", F.when(kind == 0, F.expr("left(value, 40)")), F.when(kind == 1, "not a record"), F.when(kind == 2, ""),
        F.when(kind == 3, '{"step": 3}')))).alias("value"))
    planted.write.text(folder)
    good, bad = st.route(ar.stream_trace(t.spark, folder), ar.split_trace, out)
    done = mn.trace_progress(t.spark.read.schema(ar.TRACE_SCHEMA).parquet(good), 12)
    aside = t.spark.read.parquet(bad).agg(F.count(F.lit(1)).alias("records"))
    rest = [F.lit(None).cast(f).alias(c) for c, f in (("step", "int"), ("status", "string"), ("progress", "double"))]
    return done.unionByName(aside.select(F.lit("bad lines").alias("run_id"), *rest, "records"))


query("stream_trace_progress", ["run_id", "step", "status", "records"], {"progress": 6}, """
SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(max_by(event_id % 12, ts) AS INTEGER) AS step, max_by(event_type, ts) AS status,
  max(event_id % 12) / 12.0::DOUBLE AS progress, count(*) AS records FROM events GROUP BY user_id
UNION ALL SELECT 'bad lines', NULL, NULL, NULL, count(*) FROM events WHERE event_id % 50 IN (0, 1, 3)""")(_trace_stream)
