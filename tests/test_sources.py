import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loomcast.session import scratch
from loomcast.operators.check import check_report, decide, metric_checks, score_runs
from loomcast.sources import artifacts as ar
from loomcast.sources import bars as bs
from loomcast.sources import documents as dc

T0 = dt.datetime(2024, 1, 1)


def _bars(spark):
    rows = [("A", T0 + dt.timedelta(days=i), 1.0 + i, 2.0 + i, 0.5 + i, 1.5 + i, 1.5 + i, 10.0) for i in range(5)]
    rows += [("B", T0, 9.0, 9.0, 9.0, 9.0, 9.0, 1.0)]
    return spark.createDataFrame(rows, bs.BAR_SCHEMA)


@pytest.mark.parametrize("fmt", bs.FORMATS)
def test_read_bars_formats_and_range(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    w = _bars(spark).write
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)
    df = bs.read_bars(spark, path, fmt, ["A"], dt.date(2024, 1, 2), dt.date(2024, 1, 4))
    assert [r.open for r in df.orderBy("ts").collect()] == [2.0, 3.0]


def test_unknown_source_and_no_rows(spark, tmp_path):
    with pytest.raises(ValueError):
        bs.read_bars(spark, str(tmp_path), "ftp")
    with pytest.raises(ValueError, match="no price data"):
        bs.require_rows(_bars(spark).where("symbol = 'Z'"))


def test_predicates_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    _bars(spark).write.parquet(path)
    df = bs.closes(bs.read_bars(spark, path, "parquet", ["A"], dt.datetime(2024, 1, 2)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(symbol,A)" in plan and "GreaterThanOrEqual(ts" in plan
    assert "volume" not in plan.split("ReadSchema")[1]


def test_load_adjusts_and_resamples(spark, tmp_path):
    path = str(tmp_path / "p")
    _bars(spark).withColumn("adj_close", F.col("close") / 2).write.parquet(path)
    day = bs.load_bars(spark, path, ["A"], "2024-01-01", "2024-02-01").orderBy("ts").first()
    assert (day.open, day.high, day.close) == (0.5, 1.0, 0.75)
    month = bs.load_bars(spark, path, ["A"], "2024-01-01", "2024-02-01", "1mo", auto_adjust=False).collect()
    assert [(m.open, m.high, m.low, m.close, m.volume) for m in month] == [(1.0, 6.0, 0.5, 5.5, 50.0)]
    with pytest.raises(ValueError, match="no price data"):
        bs.load_bars(spark, path, ["A"], "2030-01-01", "2030-02-01")
    with pytest.raises(ValueError, match="frequency"):
        bs.load_bars(spark, path, ["A"], "2024-01-01", "2024-02-01", "2h")


def test_normalise(spark):
    df = spark.createDataFrame([("A", 1.0, 2.0, 0.5, None, 7.0, 3.0), ("A", 1.0, 2.0, 0.5, 1.0, 7.0, 3.0)],
                               "symbol string, Open double, HIGH double, low double, close double, `Adj Close` double, Volume double")
    out = bs.normalise(df)
    assert out.columns == ["symbol", "open", "high", "low", "close", "adj_close", "volume"] and out.count() == 1
    with pytest.raises(ValueError, match="volume"):
        bs.normalise(df.drop("Volume"))


def test_save_replaces_only_its_own_run(spark, tmp_path):
    root = str(tmp_path / "pred")

    def rows(run, n):
        return spark.createDataFrame([("s", T0 + dt.timedelta(days=i), 1, 1.0, 1.0, "m", "p", run) for i in range(n)], ar.PREDICTION_SCHEMA)

    ar.save_predictions(rows("r1", 3).unionByName(rows("r2", 2)), root)
    ar.save_predictions(rows("r1", 5), root)
    assert ar.load_predictions(spark, root, "p", "r1").count() == 5
    assert ar.load_predictions(spark, root, "p", "r2").count() == 2
    with pytest.raises(FileNotFoundError):
        ar.load_predictions(spark, root, "p", "none")


def test_meta_and_worked_example(spark, tmp_path):
    """Three predictions: MAPE = 100·mean(.1/1, .1/1.5, .1/2) = 7.2222 passes a threshold of 10."""
    d = tmp_path / "p" / "r"
    d.mkdir(parents=True)
    (d / "meta.json").write_text(json.dumps({
        "plan_id": "p", "run_id": "r", "train_start": "2024-01-01", "train_end": "2024-01-31", "predict_horizon": 1,
        "metrics": [{"name": "mape", "threshold": 10.0}, {"name": "unknown", "threshold": 0.0}],
        "created_at": "2024-02-01T00:00:00Z"}, indent=1))
    meta = ar.load_meta(spark, str(tmp_path / "*" / "*" / "meta.json"))
    assert meta.first().predict_horizon == 1
    pred = spark.createDataFrame([("p", "r", y, p) for y, p in ((1.0, 1.1), (1.5, 1.4), (2.0, 1.9))],
                                 "plan_id string, run_id string, y_true double, y_pred double")
    specs = meta.select("plan_id", "run_id", F.explode("metrics").alias("m")).select(
        "plan_id", "run_id", F.col("m.name").alias("metric"), F.col("m.threshold").alias("threshold"))
    checks = metric_checks(score_runs(pred), specs)
    row = checks.collect()
    assert len(row) == 1 and abs(row[0].value - 7.222222222) < 1e-6 and row[0].passed
    rep = check_report(checks, meta).first()
    assert rep.passed and rep.r2 == 0.0 and rep.threshold == 0.0
    assert decide(check_report(checks, meta)).first().action == "noop"


def test_checkpoints(spark, tmp_path):
    for name, text in (("a__0001_100.json", '{"e": 1}'), ("a__0001_200.json", '{"e": 2}'),
                       ("a__0002_100.json", '{"e": 3}'), ("a__0002_300.json", '{"e": '), ("notes.txt", "x")):
        (tmp_path / name).write_text(text)
    got = {(r.run_id, r.epoch): (r.saved_at, r.state) for r in ar.latest_checkpoint(ar.read_checkpoints(spark, str(tmp_path))).collect()}
    assert got == {("a", 1): (200, '{"e":2}'), ("a", 2): (300, None)}


def test_file_digests(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    row = ar.file_digests(spark, str(tmp_path / "*.bin")).first()
    assert row.md5 == "900150983cd24fb0d6963f7d28e17f72"
    m = spark.createDataFrame([(row.path, row.md5), ("gone", "1")], "path string, md5 string")
    got = {os.path.basename(r.path): r.status for r in ar.checksum_diff(ar.file_digests(spark, str(tmp_path / "*.bin")), m, "path").collect()}
    assert got == {"x.bin": "OK", "gone": "MISSING"}


def test_column_evolution(spark, tmp_path):
    root = str(tmp_path / "t")
    spark.createDataFrame([("a",)], "id string").write.parquet(root)
    spark.createDataFrame([("b", "me")], "id string, owner string").write.mode("append").parquet(root)
    df = ar.ensure_column(spark.read.option("mergeSchema", True).parquet(root), "owner", F.lit("nobody"))
    assert {(r.id, r.owner) for r in df.collect()} == {("a", "nobody"), ("b", "me")}


def _doc(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, id string, seq long, created_at long, data string")


def test_document_view_after_delete_and_revival(spark):
    log = _doc(spark, [("t", "a", 1, 10, "x"), ("t", "a", 2, 20, "y"), ("t", "b", 3, 30, "z")])
    dead = spark.createDataFrame([("t", "a", 4, 40), ("t", "b", 5, 50), ("t", "never", 6, 60)],
                                 "tenant_id string, id string, seq long, created_at long")
    log = dc.delete(log, dead)
    assert dc.view(log).count() == 0
    log = dc.put(log, _doc(spark, [("t", "a", 7, 70, "new"), ("t", "a", 8, 80, "newer")]))
    row = dc.view(log).collect()
    assert [(r.id, r.data, r.created_at, r.updated_at) for r in row] == [("a", "newer", 70, 80)]


def test_document_order_ties_follow_status(spark):
    log = spark.createDataFrame([("t", "a", 1, 10, "DONE"), ("t", "a", 1, 10, "PENDING")],
                                "tenant_id string, id string, seq long, created_at long, status string")
    assert dc.latest(log).first().status == "DONE"


def test_create_conflicts_inside_a_batch(spark):
    have = _doc(spark, [("t", "a", 1, 1, "x")])
    new = _doc(spark, [("t", "a", 2, 2, "x"), ("t", "b", 3, 3, "x"), ("t", "b", 4, 4, "x")])
    got = {r.seq: r.outcome for r in dc.create_new(dc.view(have), new).collect()}
    assert got == {2: "CONFLICT", 3: "CREATED", 4: "CONFLICT"}


def test_tail_limits(spark):
    with pytest.raises(ValueError):
        dc.tail(_doc(spark, [("t", "a", 1, 1, "x")]), 0)


def _viewed(writes):
    """The latest put of each key after its last delete, a write at a time."""
    out = {}
    for tenant, key, seq, at, status, data, deleted in sorted(writes, key=lambda w: (w[2], not w[6])):
        if deleted:
            out.pop((tenant, key), None)
        else:
            first = out.get((tenant, key), (at,))[0]
            out[tenant, key] = (min(first, at), at, seq, status, data)
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_views_and_compaction_write_by_write(spark, tmp_path, parts):
    rnd = random.Random(parts)
    writes = [
        (rnd.choice(["t", "u", None]), f"k{rnd.randrange(12)}", seq, T0 + dt.timedelta(minutes=rnd.randrange(1000)),
         rnd.choice(["RUNNING", "DONE"]), f"data {seq}", rnd.random() < 0.15)
        for seq in rnd.sample(range(1000), 200)
    ]
    schema = "tenant_id string, id string, seq long, created_at timestamp, status string, data string, deleted boolean"
    writes.sort(key=lambda w: w[2])
    snapshot, size = None, -(-len(writes) // parts)
    for i in range(0, len(writes), size):
        log = spark.createDataFrame(writes[i : i + size], schema)
        dc.compact(log, snapshot).write.parquet(str(tmp_path / str(i)))
        snapshot = spark.read.parquet(str(tmp_path / str(i)))
    got = {(r.tenant_id, r.id): (r.created_at, r.updated_at, r.seq, r.status, r.data) for r in snapshot.collect()}
    assert got == _viewed(writes)


def test_winners_of_equal_order_and_equal_rows(spark):
    rows = [("t", "a", 1, "x"), ("t", "a", 1, "y"), ("t", "b", 2, "z"), ("t", "b", 2, "z"), (None, None, 3, None)]
    df = spark.createDataFrame(rows, "tenant_id string, id string, seq long, data string").withColumn(
        "tags", F.create_map(F.lit("k"), F.col("data")))
    for frame in (df.drop("tags"), df):
        got = dc.winners(frame, dc.KEY, F.col("seq")).collect()
        assert sorted(str(r.id) for r in got) == ["None", "a", "b"]
    plan = dc.latest(df.drop("tags").withColumn("created_at", F.lit(T0)))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort [" not in plan


def test_checkpoint_files_newest_and_corrupt(spark):
    rows = [("run", 1, 10, '{"a":1}'), ("run", 1, 20, '{"a":2}'), ("run", 2, 30, '{"a":'), ("a__b", 7, 5, "[1]")]
    folder = scratch(spark, "ckpts")
    saved = ar.save_checkpoints(spark.createDataFrame(rows, "run_id string, epoch int, saved_at long, state string"), folder)
    assert sorted(r.file for r in saved.collect()) == ["a__b__7_5.json", "run__1_10.json", "run__1_20.json", "run__2_30.json"]
    got = {(r.run_id, r.epoch): (r.saved_at, r.state) for r in ar.latest_checkpoint(ar.read_checkpoints(spark, folder)).collect()}
    assert got == {("run", 1): (20, '{"a":2}'), ("run", 2): (30, None), ("a__b", 7): (5, "[1]")}


def test_digests_of_files_in_chunks_and_ranges(spark, tmp_path):
    import hashlib

    data = {"edge": bytes(200_000), "small": b"abc", "long": bytes(range(256)) * 4000}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    # no value may hold the long file: the reader that puts a whole file into one fails at this limit
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100_000)
    try:
        whole = {r.path.rsplit("/", 1)[1]: r.md5 for r in ar.file_digests(spark, str(tmp_path), chunk=1000).collect()}
        parts = {r.path.rsplit("/", 1)[1]: (r.ranges, r.digest) for r in ar.range_digests(spark, str(tmp_path), 100_000, 7000).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert whole == {n: hashlib.md5(c).hexdigest() for n, c in data.items()}
    for n, c in data.items():
        cuts = [c[i : i + 100_000] for i in range(0, len(c), 100_000)]
        assert parts[n] == (len(cuts), hashlib.md5(b"".join(hashlib.md5(x).digest() for x in cuts)).hexdigest())


def test_generations_are_filled_or_fail(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, x string").write.parquet(str(tmp_path / "g=1"))
    spark.createDataFrame([(2, None, 5)], "id int, x string, y int").write.parquet(str(tmp_path / "g=2"))
    df = ar.read_generations(spark, str(tmp_path), {"x": F.lit("?"), "y": F.lit(0), "z": F.lit(9)})
    assert sorted((r.id, r.x, r.y, r.z) for r in df.collect()) == [(1, "a", 0, 9), (2, "?", 5, 9)]
    with pytest.raises(Exception, match="null after back-fill"):
        ar.read_generations(spark, str(tmp_path), {"y": F.lit(None).cast("int")}).collect()
