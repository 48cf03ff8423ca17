import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from loomcast.operators.monitor import alert_spans
from loomcast.functions.series import Axis
from loomcast.session import scratch
from loomcast.streaming import jobs as st

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, series string, ts timestamp, value double"


def _write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def test_second_call_reads_only_new_files(spark):
    src, state = scratch(spark, "src"), scratch(spark, "state")
    seen = []

    def job(df):
        return df.withColumn("doubled", F.col("value") * 2)

    for part in range(3):
        _write(spark, src, [(part * 10 + i, "a", T0, 1.0) for i in range(4)])
        out = st.incremental(spark, src, _schema(spark), job, state)
        seen.append((out.count(), out.select("batch").distinct().count()))
    assert seen == [(4, 1), (8, 2), (12, 3)]
    assert st.incremental(spark, src, _schema(spark), job, state).count() == 12


def test_windows_over_many_batches_equal_the_batch_answer(spark):
    src = scratch(spark, "src")
    for h in range(6):
        _write(spark, src, [(h * 100 + i, "ab"[i % 2], T0 + dt.timedelta(minutes=30 * h + i), float(i)) for i in range(40)])
    df = st.event_time(st.read_stream(spark, src, _schema(spark), files_per_batch=1), "ts", "1 hour")
    w = st.windowed(df, "ts", ["series"], "15 minutes", n=F.count(F.lit(1)), total=F.sum("value"))
    got = st.latest_per_key(st.run_available(w), ["series", "w_start"])
    batch = st.windowed(spark.read.parquet(src), "ts", ["series"], "15 minutes", n=F.count(F.lit(1)), total=F.sum("value"))
    assert sorted(map(tuple, got.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_duplicates_in_later_batches(spark):
    src = scratch(spark, "src")
    for _ in range(3):
        _write(spark, src, [(i, "a", T0 + dt.timedelta(seconds=i), 1.0) for i in range(20)])
    df = st.event_time(st.read_stream(spark, src, _schema(spark), files_per_batch=1), "ts", "1 hour")
    assert st.run_available(st.deduplicated(df, ["event_id"]), "append").count() == 20


def _evals(pattern):
    return [(i, "s", T0 + dt.timedelta(minutes=m), float(b)) for i, (m, b) in enumerate(pattern)]


PATTERN = [(0, 0), (1, 1), (2, 1), (3, 0), (4, 1), (5, 1), (6, 1), (7, 1), (8, 0), (9, 1), (10, 1), (11, 1), (20, 1), (21, 1), (22, 1)]


def test_alert_hold_across_batches(spark):
    """Fires once per island of at least two minutes; a gap or a good evaluation resolves it."""
    src = scratch(spark, "src")
    rows = _evals(PATTERN)
    for i in range(0, len(rows), 3):
        _write(spark, src, rows[i : i + 3])
    df = st.read_stream(spark, src, _schema(spark), files_per_batch=1)
    ev = df.select("series", F.col("ts").alias("at"), (F.col("value") > 0).alias("bad"))
    out = st.hold_alerts(ev, 120, 60).orderBy("fired_at", "state").collect()
    at = lambda m: T0 + dt.timedelta(minutes=m)
    assert [(r.state, r.since, r.fired_at) for r in out] == [
        ("FIRING", at(4), at(6)), ("RESOLVED", at(4), at(8)),
        ("FIRING", at(9), at(11)), ("RESOLVED", at(9), at(11)),
        ("FIRING", at(20), at(22)),
    ] or sorted((r.state, r.since) for r in out) == sorted(
        [("FIRING", at(4)), ("RESOLVED", at(4)), ("FIRING", at(9)), ("RESOLVED", at(9)), ("FIRING", at(20))])


def test_alert_spans_in_blocks(spark):
    rows = [("s", T0 + dt.timedelta(minutes=m), b > 0) for m, b in PATTERN] * 1
    df = spark.createDataFrame(rows, "series string, ts timestamp, bad boolean")
    for axis in (Axis(key=("series",)), Axis(key=("series",), block_rows=3)):
        got = alert_spans(df, 120, 60, axis).orderBy("since").collect()
        assert [r.since for r in got] == [T0 + dt.timedelta(minutes=m) for m in (4, 9, 20)]
        assert [r.evals for r in got] == [4, 3, 3]


def test_rates_in_blocks(spark):
    from loomcast.operators import monitor as mn

    v = [1, 2, 5, 9, 1, 3, 4, 2, 2, 6]
    pdf = pd.DataFrame({"series": "s", "ts": [T0 + dt.timedelta(seconds=20 * i) for i in range(10)], "v": [float(x) for x in v]})
    df = spark.createDataFrame(pdf)
    one = mn.rate(df, 60, Axis(key=("series",))).orderBy("w").collect()
    many = mn.rate(df, 60, Axis(key=("series",), block_rows=2)).orderBy("w").collect()
    assert one == many
    # increases: -,1,3 | 4,1(reset),2 | 1,2(reset),0 | 4
    assert [round(r.rate * 60) for r in one] == [4, 7, 3, 4]


def test_late_rows_are_counted(spark):
    src, counts = scratch(spark, "src"), {}
    for h in (0, 5, 6, 1):
        _write(spark, src, [(h * 10 + i, "a", T0 + dt.timedelta(hours=h, minutes=i), 1.0) for i in range(4)])
    df = st.event_time(st.read_stream(spark, src, _schema(spark), files_per_batch=1), "ts", "1 hour")
    w = st.windowed(df, "ts", ["series"], "30 minutes", n=F.count(F.lit(1)))
    st.run_available(w, "update", counts=counts)
    assert counts == {"rows": 16, "late": 1}  # four late rows combine to one before the state


def test_outbox_writes_each_event_once(spark):
    src, out = scratch(spark, "src"), scratch(spark, "outbox")
    for part in range(3):
        rows = [(i, "a", T0, 1.0) for i in range(5 * part, 5 * part + 10)]
        _write(spark, src, rows + rows)
        data = st.write_once(st.read_stream(spark, src, _schema(spark)), ["event_id"], out)
        got = [r.event_id for r in spark.read.parquet(data).collect()]
        assert sorted(got) == list(range(5 * part + 10))


def test_recorded_batches_are_read_whole(spark):
    """The files of a recorded batch hold its evaluations in no order of time."""
    folder = scratch(spark, "recorded")
    ev = spark.createDataFrame([("s", at, v > 0) for _, _, at, v in _evals(PATTERN)], "series string, at timestamp, bad boolean")
    ev.repartition(12, "at").write.parquet(folder + "/data/batch=0")
    out = st.hold_alerts(st.recorded(spark, folder, ev.schema), 120, 60)
    got = sorted(r.since for r in out.where("state = 'FIRING'").collect())
    assert got == [T0 + dt.timedelta(minutes=m) for m in (4, 9, 20)]


def _held(rows, hold, every):
    """The state machine, an evaluation at a time: (since, at, state) in seconds."""
    out, since, last, firing = [], None, None, False
    for at, bad in rows:
        gap = last is not None and at - last > every
        if since is not None and (gap or not bad):
            if firing:
                out.append((since, last if gap else at, "RESOLVED"))
            since, firing = None, False
        if bad and since is None:
            since = at
        if since is not None and not firing and at - since >= hold:
            firing = True
            out.append((since, since + hold, "FIRING"))
        last = at
    return sorted(out)


def test_alert_state_over_batches_and_blocks(spark):
    """Any cut into batches and blocks gives what one evaluation at a time gives."""
    rnd = random.Random(11)
    rows, want = [], {}
    for name in ("a", "b", "c"):
        at, mine = 0, []
        for _ in range(90):
            at += rnd.choice([20, 30, 60, 60, 200])
            mine.append((at, rnd.random() < 0.8))
        want[name] = _held(mine, 90, 60)
        rows += [(0, name, T0 + dt.timedelta(seconds=s), float(b)) for s, b in mine]
    rows.sort(key=lambda r: r[2])
    for cuts, block in ((1, 1 << 20), (6, 4)):
        src, size = scratch(spark, "src"), -(-len(rows) // cuts)
        for i in range(0, len(rows), size):
            part = rows[i : i + size]
            rnd.shuffle(part)
            _write(spark, src, part)
        df = st.read_stream(spark, src, _schema(spark), files_per_batch=1)
        ev = df.select("series", F.col("ts").alias("at"), (F.col("value") > 0).alias("bad"))
        got = st.hold_alerts(ev, 90, 60, block_rows=block).collect()
        assert len({r.batch for r in got}) == cuts
        for name in want:
            sec = lambda x: int((x - T0).total_seconds())
            assert sorted((sec(r.since), sec(r.fired_at), r.state) for r in got if r.series == name) == want[name]


def test_late_evaluations_are_reported(spark):
    src = scratch(spark, "src")
    for minutes in ([(0, 1), (1, 1)], [(3, 1)], [(2, 0), (4, 0)]):
        _write(spark, src, _evals(minutes))
    ev = st.read_stream(spark, src, _schema(spark), files_per_batch=1).select(
        "series", F.col("ts").alias("at"), (F.col("value") > 0).alias("bad"))
    got = sorted((r.state, r.since.minute, r.fired_at.minute) for r in st.hold_alerts(ev, 60, 120).collect())
    assert got == [("FIRING", 0, 1), ("LATE", 2, 3), ("RESOLVED", 0, 4)]


def test_outbox_reads_the_same_however_much_was_written(spark):
    src, counts = scratch(spark, "src"), []
    for part in range(14):  # every batch brings 30 new ids, and 10 of earlier ones twice
        new = [(30 * part + i, "a", T0, 1.0) for i in range(30)]
        old = [(max(0, 30 * part - 40) + i, "a", T0, 1.0) for i in range(10)] if part else []
        _write(spark, src, new + old + old)
    data = st.write_once(st.read_stream(spark, src, _schema(spark), files_per_batch=1), ["event_id"], scratch(spark, "outbox"), counts=counts)
    assert sorted(r.event_id for r in spark.read.parquet(data).collect()) == list(range(420))
    assert [known for _, _, known in counts][-1] == 420 and len(counts) == 14
    assert {looked for _, looked, _ in counts[1:]} == {40}


def test_null_ids_are_one(spark):
    src = scratch(spark, "src")
    _write(spark, src, [(None, "a", T0, 1.0), (None, "a", T0, 1.0), (1, "a", T0, 1.0)])
    _write(spark, src, [(None, "b", T0, 2.0)])
    data = st.write_once(st.read_stream(spark, src, _schema(spark), files_per_batch=1), ["event_id"], scratch(spark, "outbox"))
    assert sorted(str(r.event_id) for r in spark.read.parquet(data).collect()) == ["1", "None"]


def test_trend_refreshes_equal_one_fit(spark):
    rnd, src, state = random.Random(3), scratch(spark, "src"), scratch(spark, "trend")
    rows = [(i, rnd.choice("ab"), T0 + dt.timedelta(days=i), rnd.gauss(1000 + 3 * i, 20)) for i in range(120)]
    rows += [(500, "new", T0 + dt.timedelta(days=200), 7.0), (501, "a", None, 1.0), (502, "a", T0, None)]
    x, last = F.unix_date(F.to_date("ts")), None
    for i in range(0, len(rows), 41):
        _write(spark, src, rows[i : i + 41])
        new = st.read_stream(spark, src, _schema(spark), files_per_batch=1)
        last = st.refresh_trend(new, x, F.col("value"), ["series"], state)
    again = st.refresh_trend(st.read_stream(spark, src, _schema(spark)), x, F.col("value"), ["series"], state)
    whole = st.trend_moments(spark.createDataFrame(rows, SCHEMA), x, F.col("value"), ["series"])
    want = {r.series: r for r in st.trend_forecast(whole, 5, ["series"]).collect()}
    for frame in (last, again):
        got = st.trend_forecast(frame, 5, ["series"]).collect()
        assert {r.series for r in got} == {"a", "b", "new"}
        for r in got:
            w = want[r.series]
            assert r.n == w.n and r.x == w.x and abs(r.forecast - w.forecast) < 1e-6 and abs(r.slope - w.slope) < 1e-9


def test_nothing_arrived(spark):
    src = scratch(spark, "src")
    _write(spark, src, [])
    new = st.read_stream(spark, src, _schema(spark))
    assert st.hold_alerts(new.select("series", F.col("ts").alias("at"), (F.col("value") > 0).alias("bad")), 60, 60).count() == 0
