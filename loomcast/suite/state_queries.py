"""Document logs, run artifacts, plan configuration and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomcast.functions.expr import decode_field, digest_id
from loomcast.plans import config as cf
from loomcast.plans import validate as vd
from loomcast.session import scratch
from loomcast.sources import artifacts as ar
from loomcast.sources import documents as dc
from loomcast.suite.registry import query
from loomcast.suite.views import ctes

LOG = ctes("status_log")
LATEST = f"""{LOG}, latest AS (SELECT tenant_id, id, max(seq) AS seq, max_by(status, seq) AS status,
  max_by(data, seq) AS data, min(created_at) AS created_at, max_by(created_at, seq) AS updated_at
  FROM status_log GROUP BY tenant_id, id)"""
DOC = ["tenant_id", "id", "seq", "status", "data", "created_at", "updated_at"]


def log(t):
    return t.status_log().select("tenant_id", "id", "seq", "created_at", "status", "data")


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


# -- documents -------------------------------------------------------------------

query("doc_latest", DOC, {}, f"{LATEST} SELECT * FROM latest")(lambda t: dc.latest(log(t)))
query("doc_list", DOC, {}, f"{LATEST} SELECT * FROM latest WHERE tenant_id = 'public'")(
    lambda t: dc.list_tenant(dc.latest(log(t))))
query("doc_keys", ["tenant_id", "id"], {}, f"{LOG} SELECT DISTINCT tenant_id, id FROM status_log")(
    lambda t: dc.keys(log(t)))
query("doc_merge", ["id", "pending_data", "done_data", "status"], {"value": 2}, f"""{LOG}
SELECT id, max_by(CASE WHEN status = 'PENDING' THEN data END, CASE WHEN status = 'PENDING' THEN seq END) AS pending_data,
       max_by(CASE WHEN status = 'DONE' THEN data END, CASE WHEN status = 'DONE' THEN seq END) AS done_data,
       max_by(status, seq) AS status, max_by(value, seq) AS value FROM status_log GROUP BY id""")(
    lambda t: dc.merge_fields(t.status_log(), {
        "pending_data": F.when(F.col("status") == "PENDING", F.col("data")),
        "done_data": F.when(F.col("status") == "DONE", F.col("data")),
        "status": F.col("status"), "value": F.col("value"),
    }))
query("doc_merge_open", ["id", "fields"], {}, f"""{LOG}
SELECT id, string_agg(concat(status, '=', data), ',' ORDER BY status) AS fields FROM (
  SELECT id, status, max_by(data, seq) AS data FROM status_log GROUP BY id, status) GROUP BY id""")(
    lambda t: dc.merge_maps(
        log(t).withColumn("fields", F.create_map("status", "data")), "fields"
    ).select("id", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("fields")))
_DELETED = f"""{LOG}, d AS (SELECT id, max(seq) AS dead FROM status_log WHERE status = 'FAILED' GROUP BY id),
v AS (SELECT s.*, d.dead FROM status_log s LEFT JOIN d USING (id))
SELECT tenant_id, id, max(seq) AS seq, max_by(status, seq) AS status, max_by(data, seq) AS data,
       min(created_at) AS created_at, max_by(created_at, seq) AS updated_at
FROM v WHERE dead IS NULL OR seq > dead GROUP BY tenant_id, id"""


def deletes(t):
    """Failures are tombstones."""
    return log(t).withColumn("deleted", F.col("status") == "FAILED")


def _compacted(t):
    """The log in three parts by seq, each compacted into the stored snapshot of the ones before."""
    whole, snapshot = deletes(t), None
    low, high = whole.agg(F.min("seq"), F.max("seq")).first()
    cuts = [low + (high - low) * i // 3 for i in (1, 2)] if low is not None else [0, 0]
    for part in (F.col("seq") <= cuts[0], F.col("seq").between(cuts[0] + 1, cuts[1]), F.col("seq") > cuts[1]):
        folder = scratch(t.spark, "snapshot")
        dc.compact(whole.where(part), snapshot).write.parquet(folder)
        snapshot = t.spark.read.parquet(folder)
    return snapshot


query("doc_delete", DOC, {}, _DELETED)(lambda t: dc.view(deletes(t)))
query("doc_compacted", DOC, {}, _DELETED)(_compacted)
KEYS = "SELECT DISTINCT concat('do-', CAST(o_custkey % 300 AS VARCHAR)) AS id FROM orders"


def keys(t):
    return t.read("orders").select(
        F.lit("public").alias("tenant_id"), F.concat(F.lit("do-"), (F.col("o_custkey") % 300).cast("string")).alias("id")
    ).distinct()


query("doc_get", ["id", "seq", "status"], {}, f"""{LATEST}, k AS ({KEYS})
SELECT k.id, seq, status FROM k LEFT JOIN latest l ON k.id = l.id""")(lambda t: dc.get(dc.latest(log(t)), keys(t)))
query("doc_exists", ["id"], {}, f"{LOG}, k AS ({KEYS}) SELECT id FROM k WHERE id IN (SELECT id FROM status_log)")(
    lambda t: dc.exists(log(t), keys(t)))


query("doc_update_rejects", ["id", "outcome"], {}, f"""{LOG}, k AS ({KEYS})
SELECT id, CASE WHEN id IN (SELECT id FROM status_log) THEN 'APPLIED' ELSE 'REJECTED' END AS outcome FROM k""")(lambda t: dc.mark_updates(log(t), keys(t)))
query("doc_create_conflicts", ["seq", "id", "outcome"], {}, f"""{LOG}, known AS (SELECT DISTINCT id FROM status_log),
inc AS (SELECT o_orderkey AS seq, concat('do-', CAST(o_custkey AS VARCHAR)) AS id FROM orders)
SELECT seq, i.id, CASE WHEN k.id IS NOT NULL OR row_number() OVER (PARTITION BY i.id ORDER BY seq) > 1
  THEN 'CONFLICT' ELSE 'CREATED' END AS outcome FROM inc i LEFT JOIN known k ON i.id = k.id""")(
    lambda t: dc.create_new(log(t), t.read("orders").select(
        F.lit("public").alias("tenant_id"), F.concat(F.lit("do-"), F.col("o_custkey").cast("string")).alias("id"),
        F.col("o_orderkey").alias("seq"))))
query("lifecycle", ["id", "status", "created_at", "updated_at", "started_at", "completed_at", "writes"], {}, f"""{LOG}
SELECT id, max_by(status, seq) AS status, min(created_at) AS created_at, max(created_at) AS updated_at,
       min(CASE WHEN status = 'RUNNING' THEN created_at END) AS started_at,
       max(CASE WHEN status IN ('DONE', 'FAILED') THEN created_at END) AS completed_at, count(*) AS writes
FROM status_log GROUP BY id""")(lambda t: dc.lifecycle(log(t)))
query("tail_n", ["id", "seq", "rn"], {}, f"""{LOG}
SELECT id, seq, CAST(row_number() OVER (PARTITION BY id ORDER BY seq) AS INTEGER) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS d FROM status_log) WHERE d <= 20""")(
    lambda t: dc.tail(log(t), 20))
query("orphans", ["o_orderkey", "o_custkey"], {}, """
SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (
  SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)""")(
    lambda t: dc.orphans(t.read("orders"), t.read("customer").where("c_acctbal > 0"), "o_custkey", "c_custkey"))

# -- artifacts ---------------------------------------------------------------------


def _trace(t):
    trace = t.read("events").select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        (F.col("event_id") % 12).cast("int").alias("step"), F.col("event_type").alias("status"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.create_map(F.lit("props"), F.col("props")).alias("details"),
    )
    folder = scratch(t.spark, "trace")
    ar.append_trace(trace, folder)
    return ntz(ar.trace_in_order(ar.read_trace(t.spark, folder)), "timestamp").withColumn(
        "props", F.col("details")["props"])


query("trace_in_order", ["run_id", "step", "status", "props", "logged_at"], {}, """
SELECT concat('run-', CAST(user_id AS VARCHAR)) AS run_id, CAST(event_id % 12 AS INTEGER) AS step, event_type AS status,
       props, date_trunc('millisecond', ts) AS logged_at FROM events""")(
    lambda t: _trace(t).withColumn("logged_at", F.date_trunc("millisecond", "timestamp").cast("timestamp_ntz")))


def _ckpts(t):
    return t.status_log().select(
        F.col("id").alias("run_id"), (F.col("seq") % 12).cast("int").alias("epoch"), F.col("seq").alias("saved_at"),
        F.when(F.col("status") != "FAILED", F.col("data")).alias("state"), (F.col("status") == "FAILED").alias("corrupt"))


query("ckpt_latest", ["run_id", "epoch", "saved_at", "state"], {}, f"""{LOG}
SELECT id AS run_id, CAST(seq % 12 AS INTEGER) AS epoch, max(seq) AS saved_at,
       arg_max_null(CASE WHEN status <> 'FAILED' THEN data END, seq) AS state FROM status_log GROUP BY id, seq % 12""")(
    lambda t: ar.latest_checkpoint(_ckpts(t)))


def _ckpt_files(t):
    """A checkpoint file per status and day, and an older one of the same epoch; those of failures are cut off."""
    day = F.to_date("ts")
    saved = t.read("events").groupBy("event_type", day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    state = F.format_string('{"n":%d}', F.col("n") - F.col("older"))
    rows = saved.withColumn("older", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.col("event_type").alias("run_id"), F.unix_date("day").alias("epoch"),
        (F.unix_date("day").cast("long") * 86_400 - F.col("older")).alias("saved_at"),
        F.when(F.col("event_type") == "error", F.expr("left({0}, 4)".format("format_string('{\"n\":%d}', n)"))).otherwise(state).alias("state"))
    folder = scratch(t.spark, "ckpts")
    ar.save_checkpoints(rows, folder).count()
    return ar.latest_checkpoint(ar.read_checkpoints(t.spark, folder))


query("ckpt_files", ["run_id", "epoch", "saved_at", "state"], {}, """
SELECT event_type AS run_id, CAST(ts AS DATE) - DATE '1970-01-01' AS epoch, (CAST(ts AS DATE) - DATE '1970-01-01') * 86400 AS saved_at,
  CASE WHEN event_type <> 'error' THEN concat('{"n":', count(*), '}') END AS state FROM events GROUP BY event_type, CAST(ts AS DATE)""")(_ckpt_files)


def _digested(t):
    """The documents' texts in files (by doc_id modulo 16), in order of their ids; planted: wrong, missing and extra entries."""
    file = F.format_string("part-%02d.txt", F.col("doc_id") % 16)
    docs = t.read("documents").where("doc_id IS NOT NULL").select(file.alias("file"), "doc_id", F.coalesce("text", F.lit("")).alias("content"))
    folder = scratch(t.spark, "files")
    ar.write_files(docs.repartition("file").sortWithinPartitions("file", "doc_id"), folder).count()
    found = ar.file_digests(t.spark, folder).withColumn("file", F.regexp_extract("path", "[^/]+$", 0))
    ranged = ar.range_digests(t.spark, folder, 100_000).withColumn("file", F.regexp_extract("path", "[^/]+$", 0))
    n = F.regexp_extract("file", "[0-9]+", 0).cast("int")
    listed = found.where(n != 3).select(
        F.when(n == 5, "part-99.txt").otherwise(F.col("file")).alias("file"), F.when(n == 7, "bad").otherwise(F.col("md5")).alias("md5"))
    status = ar.checksum_diff(found, listed, "file")
    return status.join(found.select("file", "md5"), "file", "left").join(ranged.select("file", "length", "ranges"), "file", "left")


query("checksum_files", ["file", "status", "md5", "length", "ranges"], {}, """
WITH f AS (SELECT format('part-{:02d}.txt', doc_id % 16) AS file, doc_id % 16 AS n, string_agg(coalesce(text, ''), '' ORDER BY doc_id) AS content
  FROM documents WHERE doc_id IS NOT NULL GROUP BY 1, 2),
d AS (SELECT file, CASE WHEN n IN (3, 5) THEN 'EXTRA' WHEN n = 7 THEN 'MISMATCH' ELSE 'OK' END AS status, md5(content) AS md5,
  strlen(content) AS length FROM f)
SELECT file, status, md5, length, CAST(greatest(length - 1, 0) // 100000 + 1 AS INTEGER) AS ranges FROM d
UNION ALL SELECT 'part-99.txt', 'MISSING', NULL, NULL, NULL FROM f WHERE n = 5""")(_digested)


def _generations(t):
    """The log's first half was written before it had owners; the second half leaves some out."""
    folder, rows = scratch(t.spark, "generations"), log(t)
    old = F.col("seq") % 2 == 0
    rows.where(old).write.parquet(f"{folder}/generation=1")
    owner = F.when(F.col("seq") % 3 != 0, F.concat(F.lit("o-"), F.col("id")))
    rows.where(~old).drop("data").withColumn("owner", owner).write.parquet(f"{folder}/generation=2")
    return ar.read_generations(t.spark, folder, {"owner": F.lit("nobody"), "data": F.lit("{}")})


query("column_generations", ["id", "seq", "status", "data", "owner"], {}, f"""{LOG}
SELECT id, seq, status, CASE WHEN seq % 2 = 0 THEN coalesce(data, '{{}}') ELSE '{{}}' END AS data,
  CASE WHEN seq % 2 = 1 AND seq % 3 <> 0 THEN concat('o-', id) ELSE 'nobody' END AS owner FROM status_log""")(_generations)


def _tasks(t):
    e = t.read("events")
    tasks = e.select(F.col("user_id").alias("run_id"), (F.col("event_id") % 12).alias("epoch")).distinct()
    done = e.where("event_type = 'purchase'").select(F.col("user_id").alias("run_id"), (F.col("event_id") % 12).alias("epoch"))
    return tasks, done


query("skip_done", ["run_id", "epoch", "status"], {}, """
SELECT DISTINCT e.user_id AS run_id, e.event_id % 12 AS epoch,
  CASE WHEN d.user_id IS NULL THEN 'IN_PROGRESS' ELSE 'SKIPPED_DUPLICATE' END AS status
FROM events e LEFT JOIN (SELECT DISTINCT user_id, event_id % 12 AS ep FROM events WHERE event_type = 'purchase') d
  ON e.user_id = d.user_id AND e.event_id % 12 = d.ep""")(lambda t: ar.skip_done(*_tasks(t)))


def _manifest(t):
    """Planted: wrong digests, and entries listed under an id that does not exist."""
    k = F.col("doc_id")
    return t.read("documents").select(
        F.when(k % 70 == 0, k + 1_000_000_000).otherwise(k).alias("doc_id"),
        F.when(k % 50 == 0, "bad").otherwise(F.md5("text")).alias("md5"))


query("checksum_diff", ["doc_id", "status"], {}, """
WITH m AS (SELECT CASE WHEN doc_id % 70 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id,
  CASE WHEN doc_id % 50 = 0 THEN 'bad' ELSE md5(text) END AS md5 FROM documents),
a AS (SELECT doc_id, md5(text) AS md5 FROM documents)
SELECT coalesce(a.doc_id, m.doc_id) AS doc_id, CASE WHEN m.doc_id IS NULL THEN 'EXTRA' WHEN a.doc_id IS NULL THEN 'MISSING'
  WHEN a.md5 = m.md5 THEN 'OK' ELSE 'MISMATCH' END AS status FROM a FULL OUTER JOIN m ON a.doc_id = m.doc_id""")(
    lambda t: ar.checksum_diff(
        t.read("documents").select("doc_id", F.md5("text").alias("md5")), _manifest(t), "doc_id"))


def _saved(t):
    root = ar.save_predictions(t.predictions().withColumn("ts", F.col("ts").cast("timestamp")), scratch(t.spark, "predictions"))
    return ar.load_predictions(t.spark, root, plan_id="plan_demo").withColumn("ts", F.to_date("ts"))


query("predictions_saved", ["plan_id", "run_id", "symbol", "ts", "horizon", "model_id"], {"y_true": 2, "y_pred": 2},
      f"{ctes('predictions')} SELECT * FROM predictions")(_saved)


def _meta(t):
    """One meta per order as a run, written and read back as JSON."""
    o = t.read("orders")
    meta = o.select(
        F.lit("plan_demo").alias("plan_id"), F.col("o_orderkey").cast("string").alias("run_id"),
        F.date_sub(F.to_date("o_orderdate"), 30).alias("train_start"), F.to_date("o_orderdate").alias("train_end"),
        F.lit(1).alias("predict_horizon"),
        F.array(F.struct(F.lit("mape").alias("name"), (F.col("o_custkey") % 7).cast("double").alias("threshold"))).alias("metrics"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"))
    back = ar.load_meta(t.spark, ar.save_meta(meta, scratch(t.spark, "meta")), multi_line=False)
    return ntz(back, "created_at").select("*", F.explode("metrics").alias("m")).select("*", "m.name", "m.threshold")


query("meta_saved", ["run_id", "train_start", "train_end", "created_at", "name"], {"threshold": 2}, """
SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CAST(CAST(o_orderdate AS DATE) - 30 AS DATE) AS train_start,
  CAST(o_orderdate AS DATE) AS train_end, CAST(o_orderdate AS TIMESTAMP) AS created_at, 'mape' AS name,
  o_custkey % 7 AS threshold FROM orders""")(_meta)
query("column_backfill", ["id", "seq", "status", "owner"], {}, f"""{LOG}
SELECT id, seq, coalesce(CASE WHEN status <> 'RUNNING' THEN status END, 'UNKNOWN') AS status, 'nobody' AS owner FROM status_log""")(
    lambda t: ar.ensure_column(ar.ensure_column(
        log(t).withColumn("status", F.when(F.col("status") != "RUNNING", F.col("status"))), "status", F.lit("UNKNOWN")),
        "owner", F.lit("nobody")))

# -- plan configuration ----------------------------------------------------------------

PLANS = ctes("plans", "ticker_map")


def plans(t):
    return t.plans().withColumn("universe", F.array("name1", "name2"))


query("ticker_resolve", ["plan_id", "universe"], {}, f"""{PLANS}
SELECT plan_id, concat(coalesce(a.ticker, name1), ',', coalesce(b.ticker, name2)) AS universe
FROM plans LEFT JOIN ticker_map a ON a.name = name1 LEFT JOIN ticker_map b ON b.name = name2""")(
    lambda t: cf.resolve_universe(plans(t), t.ticker_map()).withColumn("universe", F.array_join("universe", ",")))

DEFAULTS = {"baseline.horizon_days": "7", "baseline.strategy": "mean", "data.frequency": "1wk", "data.source": "file",
            "Normalization": "Off", "OutlierRemoval.value.threshold": "3"}


def _leaves(t):
    p = t.plans()
    opts = F.array_compact(F.array(
        F.struct(F.lit("data.source").alias("path"), F.col("name1").alias("value")),
        F.when(F.col("plan_id") % 3 == 0, F.struct(F.lit("baseline").alias("path"), F.lit("off").alias("value"))),
        F.when(F.col("plan_id") % 5 == 0, F.struct(F.lit("Normalization.value.method").alias("path"), F.lit("minmax").alias("value"))),
        F.when(F.col("plan_id") % 7 == 0, F.struct(F.lit("baseline.horizon_days.max").alias("path"), F.lit("9").alias("value"))),
        F.struct(F.lit("owner.name").alias("path"), F.col("name2").alias("value")),
    ))
    return p.select("plan_id", F.explode(opts).alias("o")).select("plan_id", "o.*")


_DEF = ", ".join(f"('{k}', '{v}')" for k, v in DEFAULTS.items())
query("defaults_overlay", ["plan_id", "path", "value"], {}, f"""{PLANS}, leaves AS (
  SELECT plan_id, 'data.source' AS path, name1 AS value FROM plans
  UNION ALL SELECT plan_id, 'baseline', 'off' FROM plans WHERE plan_id % 3 = 0
  UNION ALL SELECT plan_id, 'Normalization.value.method', 'minmax' FROM plans WHERE plan_id % 5 = 0
  UNION ALL SELECT plan_id, 'baseline.horizon_days.max', '9' FROM plans WHERE plan_id % 7 = 0
  UNION ALL SELECT plan_id, 'owner.name', name2 FROM plans)
SELECT * FROM leaves UNION ALL
SELECT p.plan_id, d.path, d.value FROM plans p, (VALUES {_DEF}) d(path, value) WHERE NOT EXISTS (
  SELECT 1 FROM leaves l WHERE l.plan_id = p.plan_id AND
    (l.path = d.path OR starts_with(l.path, concat(d.path, '.')) OR starts_with(d.path, concat(l.path, '.'))))""")(
    lambda t: cf.overlay_defaults(_leaves(t), DEFAULTS))


def _plan_rows(t):
    return plans(t).select(
        "plan_id", F.when(F.col("plan_id") % 4 != 0, F.col("universe")).alias("universe"),
        F.when(F.col("plan_id") % 3 == 0, F.col("name2")).alias("symbol"),
        F.when(F.col("plan_id") % 5 == 0, F.lit("2024-02-01")).alias("start"), F.lit(None).cast("string").alias("end"),
        F.lit("2024-01-01").alias("train_start"), F.lit("2024-06-30").alias("train_end"),
    )


_PLAN_ROWS = f"""{PLANS}, p AS (SELECT plan_id, CASE WHEN plan_id % 4 <> 0 THEN name1 END AS u0,
  CASE WHEN plan_id % 3 = 0 THEN name2 END AS symbol, CASE WHEN plan_id % 5 = 0 THEN '2024-02-01' END AS s FROM plans)"""
query("plan_legacy", ["plan_id", "symbol", "start", "end_"], {}, f"""{_PLAN_ROWS}
SELECT plan_id, coalesce(symbol, u0, '') AS symbol, coalesce(s, '2024-01-01') AS start, '2024-06-30' AS end_ FROM p""")(
    lambda t: cf.legacy_fields(_plan_rows(t)).withColumnRenamed("end", "end_"))


def _merged(t):
    pl = _plan_rows(t).withColumn("end", F.col("train_end")).withColumn(
        "indicators", F.when(F.col("plan_id") % 2 == 0, F.array(F.lit("EMA:9"))))
    req = t.read("orders").select(
        "o_orderkey", F.col("o_custkey").alias("plan_id"), F.when(F.col("o_orderkey") % 3 == 0, "").when(
            F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority")).alias("symbol"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("2024-03-01")).alias("start"), F.lit(None).cast("string").alias("end"),
        F.lit(None).cast("array<string>").alias("indicators"),
        F.lit(None).cast("int").alias("run_no"), F.when(F.col("o_orderkey") % 5 == 0, 4).alias("seq"))
    return cf.merge_params(req, pl).withColumn("indicators", F.array_join("indicators", ",")).withColumnsRenamed(
        {"start": "start_", "end": "end_"})


query("param_merge", ["o_orderkey", "plan_id", "symbol", "start_", "end_", "indicators", "run_no", "reason"], {}, f"""{_PLAN_ROWS},
r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS rs,
  CASE WHEN o_orderkey % 2 = 0 THEN '2024-03-01' END AS st, CASE WHEN o_orderkey % 5 = 0 THEN 4 ELSE 1 END AS rn FROM orders),
m AS (SELECT o_orderkey, o_custkey AS plan_id, coalesce(rs, nullif(symbol, ''), u0) AS symbol, coalesce(st, s) AS start_,
  CASE WHEN plan_id IS NOT NULL THEN '2024-06-30' END AS end_,
  CASE WHEN plan_id % 2 = 0 THEN 'EMA:9' ELSE 'SMA:5' END AS indicators, rn AS run_no, plan_id AS known
  FROM r LEFT JOIN p ON plan_id = o_custkey)
SELECT o_orderkey, plan_id, symbol, start_, end_, indicators, run_no, CASE WHEN known IS NULL THEN 'plan not found'
  WHEN start_ IS NULL OR end_ IS NULL THEN 'start/end missing' WHEN coalesce(symbol, '') = '' THEN 'symbol missing' END AS reason
FROM m""")(_merged)


def _flat(t):
    df = t.read("events").select(
        "event_id", F.create_map(F.lit("r2"), F.lit(0.5), F.lit("value"), "value").alias("result"),
        F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("r2"), F.col("value") / 1000, F.lit("rmse"), "value")).alias("metrics"))
    return cf.flatten_metric_maps(df, "result", "metrics", "m").withColumn("missing", F.array_join(
        cf.missing_keys("m", ["r2", "rmse", "passed"]), ",")).withColumns({"r2": F.col("m")["r2"], "rmse": F.col("m")["rmse"]})


query("metrics_flatten", ["event_id", "missing"], {"r2": 6, "rmse": 4}, """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'passed' ELSE 'rmse,passed' END AS missing,
  CASE WHEN event_id % 2 = 0 THEN value / 1000 ELSE 0.5 END AS r2, CASE WHEN event_id % 2 = 0 THEN value END AS rmse FROM events""")(_flat)
query("horizon_clean", ["c_custkey", "clean", "reason"], {}, """
WITH h AS (SELECT c_custkey, concat(CAST(c_custkey % 30 AS VARCHAR), ', ', CAST(c_nationkey AS VARCHAR), ',x,-3,',
  CAST(c_custkey % 30 AS VARCHAR)) AS s FROM customer),
l AS (SELECT c_custkey, list_sort(list_distinct(list_filter(list_transform(string_split(s, ','), lambda x: TRY_CAST(trim(x) AS INTEGER)),
  lambda x: x > 0))) AS c FROM h)
SELECT c_custkey, CASE WHEN len(c) > 0 THEN array_to_string(c, ',') END AS clean,
  CASE WHEN len(c) = 0 THEN 'no horizon above 0' END AS reason FROM l""")(
    lambda t: cf.with_horizons(t.read("customer").withColumn("horizons", F.concat(
        (F.col("c_custkey") % 30).cast("string"), F.lit(", "), F.col("c_nationkey").cast("string"), F.lit(",x,-3,"),
        (F.col("c_custkey") % 30).cast("string")))).withColumn("clean", F.array_join("clean", ",")))
query("event_decode", ["event_id", "props", "raw"], {}, """
SELECT event_id, replace(props, ': ', ':') AS props, concat('"', event_type, '"') AS raw FROM events""")(
    lambda t: t.read("events").select("event_id", decode_field(F.encode("props", "UTF-8")).alias("props"),
                                      decode_field(F.encode("event_type", "UTF-8")).alias("raw")))
query("stable_ids", ["plan_id", "do_id"], {}, f"""{PLANS}
SELECT plan_id, concat('do-', substr(sha256(concat(length(CAST(plan_id AS VARCHAR)), ':', plan_id)), 1, 32)) AS do_id FROM plans""")(
    lambda t: t.plans().select("plan_id", digest_id("do-", "plan_id").alias("do_id")))
# parts that would read alike without their lengths: 'a|' and 'b', 'a' and '|b', with nulls on either side
query("stable_ids_parts", ["event_id", "id"], {}, """
SELECT event_id, concat('p-', substr(sha256(coalesce(length(a) || ':' || a, '-') || coalesce(length(b) || ':' || b, '-')), 1, 32)) AS id
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'x|' WHEN 1 THEN 'x' WHEN 2 THEN NULL ELSE 'x|y' END AS a,
  CASE event_id % 4 WHEN 0 THEN 'y' WHEN 1 THEN '|y' WHEN 2 THEN 'x|y' ELSE NULL END AS b FROM events)""")(
    lambda t: t.read("events").withColumns({
        "a": F.expr("CASE event_id % 4 WHEN 0 THEN 'x|' WHEN 1 THEN 'x' WHEN 2 THEN NULL ELSE 'x|y' END"),
        "b": F.expr("CASE event_id % 4 WHEN 0 THEN 'y' WHEN 1 THEN '|y' WHEN 2 THEN 'x|y' ELSE NULL END"),
    }).select("event_id", digest_id("p-", "a", "b").alias("id")))

# -- validation ----------------------------------------------------------------------------


def _settings(t):
    k = F.col("c_custkey")
    return t.read("customer").select(
        k.alias("plan_id"), F.when(k % 11 != 0, k % 400).alias("lookback_days"), (F.col("c_nationkey") * 5).alias("horizon_days"),
        F.when(k % 9 == 0, "avg").when(k % 2 == 0, "median").alias("strategy"),
        F.when(k % 13 == 0, "plan_v2").otherwise("plan_v1").alias("version"), F.when(k % 17 != 0, k * 9).alias("row_count"),
        F.when(k % 19 == 0, F.array().cast("array<struct<name:string,window:int,alpha:double>>")).otherwise(F.array(F.struct(
            F.when(k % 23 == 0, "Wavelet").when(k % 2 == 0, "MovingAverage").otherwise("ExponentialSmoothing").alias("name"),
            (k % 5).cast("int").alias("window"), (F.col("c_acctbal") / 8000).alias("alpha")))).alias("feature_blocks"),
        F.when(k % 7 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment")).alias("symbol"),
        F.when(k % 29 != 0, F.lit("2024-01-01")).alias("start"), F.when(k % 37 == 0, "2024-99-99").when(k % 73 == 0, "30.6.2024").otherwise("2024-06-30").alias("end"),
        F.array(F.struct(F.when(k % 31 == 0, "KST").when(k % 41 != 0, "SMA").alias("name"), (k % 4).cast("int").alias("window"))).alias("indicators"),
        F.when(k % 61 != 0, F.array(F.struct(
            F.when(k % 43 != 0, "r2").alias("name"), F.when(k % 47 != 0, F.col("c_acctbal") / 1000).alias("threshold")))).alias("metrics"),
        F.when(k % 67 != 0, F.col("c_nationkey") % 4).alias("predict_horizon"),
        F.when(k % 53 != 0, F.lit("run")).alias("run_id"), F.when(k % 59 != 0, F.lit("2024-01-01")).alias("train_start"),
        F.create_map(F.when(k % 8 == 0, "owner").otherwise("notes"), F.lit("x")).alias("keys"),
        F.when(k % 6 == 0, F.create_map(F.lit("plan_id"), F.lit("x"), F.lit("color"), F.lit("red"))).otherwise(
            F.create_map(F.lit("plan_id"), F.lit("x"))).alias("raw"),
        (k % 3).alias("run_no"), F.repeat(F.lit("t"), (k % 40).cast("int")).alias("run_tag"), (k % 2).alias("seq"),
    )


def _rules(*rows):
    """(condition, rule, path) rows over customer as one SQL text."""
    return " UNION ALL ".join(
        f"SELECT c_custkey AS plan_id, '{r}' AS rule, '{p}' AS path FROM customer WHERE {c}" for c, r, p in rows)


VIOLATION = ["plan_id", "rule", "path"]
query("violations_baseline", VIOLATION, {}, _rules(
    ("c_custkey % 11 = 0", "required", "baseline.lookback_days"),
    ("c_custkey % 11 <> 0 AND (c_custkey % 400 < 1 OR c_custkey % 400 > 365)", "range", "baseline.lookback_days"),
    ("c_nationkey * 5 < 1 OR c_nationkey * 5 > 90", "range", "baseline.horizon_days"),
    ("c_custkey % 9 = 0", "enum", "baseline.strategy")))(lambda t: vd.check_baseline(_settings(t), ["plan_id"]))
query("violations_plan", VIOLATION, {}, _rules(
    ("c_custkey % 13 = 0", "const", "version"),
    ("c_custkey % 17 = 0", "required", "row_count"),
    ("c_custkey % 17 <> 0 AND c_custkey * 9 NOT BETWEEN 40 AND 10000", "range", "row_count"),
    ("c_custkey % 19 = 0", "minItems", "feature_blocks"),
    ("c_custkey % 19 <> 0 AND c_custkey % 23 = 0", "enum", "feature_blocks.name"),
    ("c_custkey % 19 <> 0 AND c_custkey % 23 <> 0 AND c_custkey % 2 = 0 AND c_custkey % 5 < 1", "range", "feature_blocks.window"),
    ("c_custkey % 19 <> 0 AND c_custkey % 23 <> 0 AND c_custkey % 2 = 1 AND c_acctbal / 8000 NOT BETWEEN 0 AND 1", "range", "feature_blocks.alpha"),
))(lambda t: vd.check_plan(_settings(t), ["plan_id"]))
query("violations_dsl", VIOLATION, {}, _rules(
    ("TRUE", "const", "version"), ("c_custkey % 7 = 0", "pattern", "symbol"),
    ("c_custkey % 29 = 0", "required", "period.start"), ("c_custkey % 31 = 0", "enum", "indicators.name"),
    ("c_custkey % 37 = 0 OR c_custkey % 73 = 0", "format", "period.end"), ("c_custkey % 8 = 0", "additionalProperties", "plan"),
    ("c_custkey % 31 <> 0 AND c_custkey % 41 = 0", "required", "indicators.name"),
    ("c_custkey % 4 < 2", "range", "indicators.window")))(lambda t: vd.check_plan_dsl(_settings(t), ["plan_id"], "keys"))
query("violations_request", VIOLATION, {}, _rules(
    ("c_custkey % 3 < 1", "range", "run_no"), ("c_custkey % 2 < 1", "range", "seq"), ("c_custkey % 40 > 32", "maxLength", "run_tag"),
    ("c_custkey % 4 NOT BETWEEN 1 AND 200", "range", "indicators.window")))(lambda t: vd.check_request(_settings(t), ["plan_id"]))
query("violations_run", VIOLATION, {}, _rules(
    ("c_custkey % 13 = 0", "const", "version"), ("c_custkey % 5 = 0", "required", "run_no"),
    ("c_custkey % 5 <> 0 AND c_custkey % 3 < 1", "range", "run_no"), ("c_custkey % 7 = 0", "additionalProperties", "overrides")))(
    lambda t: vd.check_run_dsl(_settings(t).select(
        "plan_id", F.when(F.col("plan_id") % 13 != 0, "1.0").alias("version"),
        F.when(F.col("plan_id") % 5 != 0, F.col("run_no")).alias("run_no"),
        F.create_map(F.when(F.col("plan_id") % 7 == 0, "color").otherwise("symbol"), F.lit("x")).alias("overrides")),
        ["plan_id"], "overrides"))
query("violations_meta", VIOLATION, {}, _rules(
    ("c_acctbal < 0 AND c_custkey % 47 <> 0 AND c_custkey % 61 <> 0", "range", "metrics.threshold"),
    ("c_nationkey % 4 < 1 AND c_custkey % 67 <> 0", "range", "predict_horizon"),
    ("c_custkey % 67 = 0", "required", "predict_horizon"), ("c_custkey % 61 = 0", "required", "metrics"),
    ("c_custkey % 53 = 0", "required", "run_id"), ("c_custkey % 59 = 0", "required", "train_start"), ("TRUE", "required", "train_end"),
    ("c_custkey % 61 <> 0 AND c_custkey % 43 = 0", "required", "metrics.name"),
    ("c_custkey % 61 <> 0 AND c_custkey % 47 = 0", "required", "metrics.threshold"),
    ("c_custkey % 6 = 0", "additionalProperties", "meta")))(
    lambda t: vd.check_meta(_settings(t), ["plan_id"], ["plan_id", "run_id"], "raw"))
query("violations_report", ["event_id", "rule", "path"], {}, """
SELECT event_id, 'range' AS rule, 'r2' AS path FROM events WHERE 1 - value / 10 < -1 OR 1 - value / 10 > 1
UNION ALL SELECT event_id, 'range', 'threshold' FROM events WHERE value / 100 > 1""")(
    lambda t: vd.check_reports(t.read("events").select(
        "event_id", (1 - F.col("value") / 10).alias("r2"), (F.col("value") / 100).alias("threshold")), ["event_id"]))
query("violations_series", ["symbol", "ts", "n"], {}, """
SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ts, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")(
    lambda t: vd.check_series(t.read("lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("ts"))))
query("series_bounds", ["symbol", "row_count", "span_days", "lookback_days", "ok"], {}, f"""{ctes('bars_wide')}
SELECT symbol, count(*) AS row_count, CAST(date_diff('day', min(ts), max(ts)) AS INTEGER) AS span_days,
  CAST(least(greatest(date_diff('day', min(ts), max(ts)), 1), 365) AS INTEGER) AS lookback_days, count(*) BETWEEN 40 AND 10000 AS ok
FROM bars_wide GROUP BY symbol""")(lambda t: vd.series_bounds(t.bars_wide()))
query("violations_pairs", ["symbol", "ts", "rule"], {}, f"""{ctes('bars_daily', 'predictions')}
SELECT symbol, ts, 'no prediction' AS rule FROM bars_daily b
WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.symbol = b.symbol AND p.ts = b.ts)""")(
    lambda t: vd.check_pairs(t.bars_daily(), t.predictions(), ["symbol", "ts"]))
query("violations_ensemble", VIOLATION, {}, _rules(
    ("c_custkey % 5 NOT IN (1, 2)", "enum", "level"), ("c_custkey % 4 = 0", "minItems", "base_models"),
    ("c_custkey % 6 = 0", "enum", "base_models"), ("c_acctbal < 0", "range", "weights"),
    ("c_custkey % 4 = 0", "length", "weights")))(
    lambda t: vd.check_ensemble(t.read("customer").select(
        F.col("c_custkey").alias("plan_id"), (F.col("c_custkey") % 5).alias("level"),
        F.when(F.col("c_custkey") % 4 == 0, F.array(F.when(F.col("c_custkey") % 6 == 0, "ARIMA").otherwise("GRU"))).otherwise(
            F.array(F.lit("LSTM"), F.when(F.col("c_custkey") % 6 == 0, "ARIMA").otherwise("GRU"))).alias("base_models"),
        F.array(F.col("c_acctbal"), F.lit(1.0)).alias("weights")), ["plan_id"]))
