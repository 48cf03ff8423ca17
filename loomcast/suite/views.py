"""Inputs of the registered queries: bars, samples, logs and plans derived from the
given tables, in Spark and as SQL text for the comparison."""

from __future__ import annotations

import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.functions.series import DAILY, Axis, lay_out, longest_series
from loomcast.operators.monitor import SAMPLES
from loomcast.sources.bars import to_bars

#: Raw events in time order per type: five types, so each may be very long (measured).
EVENTS = Axis(key=("event_type",), order="ts", tie=("event_id",))


class Tables:
    """The tables of one folder and the inputs derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._longest: int | None = None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def path(self, name: str) -> str:
        return os.path.join(self.dir, f"{name}.parquet")

    # -- bars ------------------------------------------------------------------
    def bars_daily(self) -> DataFrame:
        return to_bars(
            self.read("orders"), F.col("o_orderpriority"), F.to_date("o_orderdate"), F.col("o_totalprice"),
            F.col("o_orderkey"),
        )

    def bars_hourly(self) -> DataFrame:
        hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
        return to_bars(self.read("events"), F.col("event_type"), hour, F.col("value"), F.col("event_id"))

    def bars_wide(self) -> DataFrame:
        return to_bars(
            self.read("lineitem"), F.col("l_suppkey"), F.to_date("l_shipdate"), F.col("l_extendedprice"),
            (F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 100_000_000 + F.col("l_partkey"), F.col("l_quantity"),
        )

    def bars_gappy(self) -> DataFrame:
        """Every 7th bar of a series has no close."""
        df = lay_out(self.bars_daily().select("symbol", "ts", "close"), DAILY).number("rn").rows()
        return df.withColumn("close", F.when(F.col("rn") % 7 != 0, F.col("close"))).drop("rn")

    # -- predictions and runs ----------------------------------------------------
    def predictions(self) -> DataFrame:
        """Naive last-value forecast, one run per symbol."""
        b = lay_out(self.bars_daily().select("symbol", "ts", "close"), DAILY, 1)
        df = b.add({"prev": b.lag("close")}).rows().where("prev IS NOT NULL")
        return df.select(
            F.lit("plan_demo").alias("plan_id"), F.col("symbol").alias("run_id"), "symbol", "ts",
            F.lit(1).alias("horizon"), F.col("close").alias("y_true"), F.col("prev").alias("y_pred"),
            F.lit("naive").alias("model_id"),
        )

    def meta(self) -> DataFrame:
        """Thresholds that every run of the predictions has, one unknown to the check."""
        pairs = F.array(*[
            F.struct(F.lit(m).alias("metric"), F.lit(t).alias("threshold"))
            for m, t in (("mape", 10.0), ("rmse", 200000.0), ("r2", 0.8), ("mae", 1.0))
        ])
        runs = self.runs()
        return runs.select("plan_id", "run_id", F.explode(pairs).alias("_p")).select("plan_id", "run_id", "_p.*")

    def runs(self) -> DataFrame:
        return self.read("orders").select(
            F.lit("plan_demo").alias("plan_id"), F.col("o_orderpriority").alias("run_id")
        ).distinct()

    # -- logs ----------------------------------------------------------------------
    def status_log(self) -> DataFrame:
        status = (
            F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "purchase", "DONE")
            .when(F.col("event_type") == "error", "FAILED").otherwise("RUNNING")
        )
        return self.read("events").select(
            F.lit("public").alias("tenant_id"), F.concat(F.lit("do-"), F.col("user_id").cast("string")).alias("id"),
            F.col("event_id").alias("seq"), F.col("ts").alias("created_at"), status.alias("status"),
            F.col("props").alias("data"), "value", "user_id",
        )

    def plans(self) -> DataFrame:
        c, n = self.read("customer"), self.read("nation")
        return c.join(n, c.c_nationkey == n.n_nationkey).select(
            F.col("c_custkey").alias("plan_id"), F.col("c_mktsegment").alias("name1"), F.col("n_name").alias("name2"),
            "c_acctbal", "c_nationkey",
        )

    def ticker_map(self) -> DataFrame:
        """Every third name is listed in an older spelling, so it stays unknown."""
        name = F.when(F.col("n_nationkey") % 3 == 0, F.concat("n_name", F.lit(" (old)"))).otherwise(F.col("n_name"))
        return self.read("nation").select(
            name.alias("name"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("ticker")
        )

    # -- samples ---------------------------------------------------------------------
    def longest_type(self) -> int:
        """Events of the most frequent type, measured once."""
        if self._longest is None:
            self._longest = longest_series(self.read("events"), EVENTS.key)
        return self._longest

    def sample_axis(self) -> Axis:
        """There is one sample per event."""
        return SAMPLES.but(max_rows=self.longest_type())

    def samples(self, since: int | None = None, until: int | None = None) -> DataFrame:
        """Counter per event type that resets every day; ``total`` counts up the values.  The whole days that
        hold the epoch seconds ``since`` to ``until`` are counted alone, as the filter goes down to the scan."""
        ev = self.read("events")
        at = lambda s: F.lit(datetime.fromtimestamp(s, timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")
        if since is not None:
            ev = ev.where(F.col("ts") >= at(since // 86_400 * 86_400))
        if until is not None:
            ev = ev.where(F.col("ts") <= at(until))
        ev = ev.withColumn("_day", F.to_date("ts"))
        b = lay_out(ev, EVENTS.but(max_rows=self.longest_type())).running_sum(
            {"v": F.lit(1).cast("long"), "total": F.col("value")}, within=("_day",)
        )
        return b.rows().select(
            F.col("event_type").alias("series"), "ts", F.col("v").cast("double").alias("v"), "total"
        )


def ctes(*views: str, recursive: bool = False) -> str:
    """A WITH clause over the named views (and what they need), each once, in order."""
    names: list[str] = []

    def need(v: str) -> None:
        for d in DEPENDS.get(v, ()):
            need(d)
        if v not in names:
            names.append(v)

    for v in views:
        need(v)
    body = ",\n".join(f"{v} AS MATERIALIZED ({SQL[v].strip()})" for v in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}"


DEPENDS = {"bars_gappy": ("bars_daily",), "predictions": ("bars_daily",), "hourly_rn": ("bars_hourly",)}

SQL = {
    "bars_daily": """
SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS ts,
       min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
       max_by(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)""",
    "bars_hourly": """
SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
       min_by(value, event_id) AS open, max(value) AS high, min(value) AS low,
       max_by(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY event_type, date_trunc('hour', ts)""",
    "hourly_rn": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars_hourly",
    "bars_wide": """
SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ts,
       min_by(l_extendedprice, (l_orderkey * 100 + l_linenumber) * 100000000 + l_partkey) AS open, max(l_extendedprice) AS high,
       min(l_extendedprice) AS low, max_by(l_extendedprice, (l_orderkey * 100 + l_linenumber) * 100000000 + l_partkey) AS close,
       sum(l_quantity) AS volume
FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "bars_gappy": """
SELECT symbol, ts, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) % 7 = 0
       THEN NULL ELSE close END AS close FROM bars_daily""",
    "predictions": """
SELECT 'plan_demo' AS plan_id, symbol AS run_id, symbol, ts, 1 AS horizon, close AS y_true, prev AS y_pred,
       'naive' AS model_id
FROM (SELECT symbol, ts, close, lag(close, 1) OVER (PARTITION BY symbol ORDER BY ts) AS prev FROM bars_daily) b
WHERE prev IS NOT NULL""",
    "meta": """
SELECT metric, CAST(threshold AS DOUBLE) AS threshold
FROM (VALUES ('mape', 10.0), ('rmse', 200000.0), ('r2', 0.8), ('mae', 1.0)) AS m(metric, threshold)""",
    "status_log": """
SELECT 'public' AS tenant_id, concat('do-', CAST(user_id AS VARCHAR)) AS id, event_id AS seq, ts AS created_at,
       CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'FAILED'
            ELSE 'RUNNING' END AS status, props AS data, value, user_id FROM events""",
    "samples": """
SELECT event_type AS series, ts, CAST(count(*) OVER w AS DOUBLE) AS v, sum(value) OVER w AS total FROM events
WINDOW w AS (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "plans": """
SELECT c_custkey AS plan_id, c_mktsegment AS name1, n_name AS name2, c_acctbal, c_nationkey
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "ticker_map": """
SELECT CASE WHEN n_nationkey % 3 = 0 THEN concat(n_name, ' (old)') ELSE n_name END AS name,
       concat('N', CAST(n_nationkey AS VARCHAR)) AS ticker FROM nation""",
}
