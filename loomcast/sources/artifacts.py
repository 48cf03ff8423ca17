"""Run artifacts on shared storage: predictions, run meta, checkpoints, checksums."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcast.functions.series import epoch_micros
from loomcast.sources.documents import winners

PREDICTION_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("horizon", T.IntegerType()),
    T.StructField("y_true", T.DoubleType()),
    T.StructField("y_pred", T.DoubleType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("plan_id", T.StringType()),
    T.StructField("run_id", T.StringType()),
])
META_SCHEMA = T.StructType([
    T.StructField("plan_id", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("train_start", T.DateType()),
    T.StructField("train_end", T.DateType()),
    T.StructField("predict_horizon", T.IntegerType()),
    T.StructField("metrics", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
    ]))),
    T.StructField("created_at", T.TimestampType()),
])
TRACE_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("step", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("details", T.MapType(T.StringType(), T.StringType())),
])


def save_predictions(df: DataFrame, root: str) -> str:
    """Write predictions, one directory per (plan_id, run_id); a rerun replaces its own run.

    Rows are rebalanced by run: the adaptive planner splits a huge run over many tasks
    and puts small runs together, so neither giant nor countless tiny files are written.
    With dynamic overwrite other runs stay as they are.
    """
    (
        df.hint("rebalance", "plan_id", "run_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("plan_id", "run_id")
        .parquet(root)
    )
    return root


def load_predictions(
    spark: SparkSession, root: str, plan_id: str | None = None, run_id: str | None = None,
    schema: T.StructType = PREDICTION_SCHEMA,
) -> DataFrame:
    """All predictions, or one run's (partition pruning); a missing run is an error."""
    df = spark.read.schema(schema).parquet(root)
    if plan_id is not None:
        df = df.where(F.col("plan_id") == plan_id)
    if run_id is not None:
        df = df.where(F.col("run_id") == run_id)
    if (plan_id or run_id) and df.isEmpty():
        raise FileNotFoundError(f"no predictions for plan {plan_id}, run {run_id}")
    return df


def save_meta(meta: DataFrame, root: str) -> str:
    """Append run metas as JSON, one per line (read with ``multi_line=False``)."""
    meta.write.mode("append").json(root)
    return root


def load_meta(spark: SparkSession, pattern: str, multi_line: bool = True) -> DataFrame:
    """All run metas under a path pattern in one scan."""
    return spark.read.schema(META_SCHEMA).option("multiLine", multi_line).json(pattern)


def append_trace(records: DataFrame, path: str) -> str:
    """Append trace records as JSON lines."""
    records.write.mode("append").json(path)
    return path


def mark_done(done: DataFrame, path: str) -> str:
    """Append (run_id, epoch) rows of finished work."""
    done.select("run_id", "epoch").write.mode("append").parquet(path)
    return path


#: a line that is no record keeps its text here
TRACE_BAD = "bad_line"


def stream_trace(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Trace records of a growing folder of JSON lines, as a stream.  A line that can't be
    read has its text in ``bad_line`` and no run; blank lines are skipped."""
    schema = T.StructType([*TRACE_SCHEMA.fields, T.StructField(TRACE_BAD, T.StringType())])
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", TRACE_BAD).json(path)


def split_trace(trace: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records, and the lines kept aside: unreadable ones and records without a run."""
    bad = F.col(TRACE_BAD).isNotNull() | F.col("run_id").isNull()
    return trace.where(~bad).drop(TRACE_BAD), trace.where(bad)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Trace records from JSON lines; blank lines are skipped."""
    return spark.read.schema(TRACE_SCHEMA).json(path).where(F.col("run_id").isNotNull())


def trace_in_order(trace: DataFrame, run: Column | None = None) -> DataFrame:
    """Records by run and time (a range sort, not one task)."""
    df = trace if run is None else trace.where(run)
    return df.orderBy("run_id", "timestamp", "step")


def _file_system(path: str):
    """The file system of a path or address that all executors see, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def write_files(rows: DataFrame, folder: str, name: str = "file", content: str = "content") -> DataFrame:
    """One file per value of ``name`` under ``folder``: the ``content`` of its rows one after another, as the rows come
    within their partition (partition by name and sort before).  Gives (file, bytes).

    A file is written under a name of its own attempt and then moved, so a repeated task replaces it as a whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = out = system = None
        done: list[tuple[str, int]] = []

        def close() -> None:
            if out is not None:
                done.append((at, out.tell()))
                out.close()
                system.move(f"{target}/.{at}.{token}", f"{target}/{at}")

        token = os.urandom(6).hex()
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file != at:
                    close()
                    system, target = _file_system(folder)
                    system.create_dir(target, recursive=True)
                    at, out = file, system.open_output_stream(f"{target}/.{file}.{token}", compression=None)
                out.write(text or b"")
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["file", "bytes"])

    return rows.select(name, F.col(content).cast("binary")).where(F.col(name).isNotNull()).mapInArrow(run, "file string, bytes bigint")


def save_checkpoints(ckpts: DataFrame, folder: str) -> DataFrame:
    """Write (run_id, epoch, saved_at, state text) rows as checkpoint files, a file each; gives (file, bytes)."""
    file = F.format_string("%s__%d_%d.json", "run_id", "epoch", "saved_at")
    rows = ckpts.select(file.alias("file"), F.col("state").alias("content")).repartition("file").sortWithinPartitions("file")
    return write_files(rows, folder)


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoint files named <run>__<epoch>_<unix seconds>.json: one row each with
    (run_id, epoch, saved_at, state, corrupt)."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
        F.col("value"),
    )
    name = r"^(.*)__(\d+)_(\d+)\.json$"
    state = F.try_parse_json("value")
    return raw.select(
        F.regexp_extract("file", name, 1).alias("run_id"),
        F.regexp_extract("file", name, 2).try_cast("int").alias("epoch"),
        F.regexp_extract("file", name, 3).try_cast("long").alias("saved_at"),
        "modified_at",
        F.to_json(state).alias("state"),
        state.isNull().alias("corrupt"),
    ).where(F.col("run_id") != "")


def latest_checkpoint(ckpts: DataFrame, order: str = "saved_at") -> DataFrame:
    """The newest checkpoint per (run, epoch); its state is null when the file is corrupt."""
    key = ("run_id", "epoch")
    rows = ckpts.select(*key, order, F.when(~F.col("corrupt"), F.col("state")).alias("state"))
    at = epoch_micros(F.col(order), dict(rows.dtypes)[order])
    return winners(rows, key, at).select(*key, order, "state")


def skip_done(tasks: DataFrame, done: DataFrame, on: tuple[str, ...] = ("run_id", "epoch")) -> DataFrame:
    """Tasks with status SKIPPED_DUPLICATE where already done, else IN_PROGRESS."""
    mark = done.select(*on).distinct().withColumn("_done", F.lit(True))
    status = F.when(F.col("_done"), "SKIPPED_DUPLICATE").otherwise("IN_PROGRESS")
    return tasks.join(mark, list(on), "left").withColumn("status", status).drop("_done")


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length) of files; their content isn't read.  Spark's readers pass over empty files."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length")


def file_digests(spark: SparkSession, pattern: str, chunk: int = 8 << 20) -> DataFrame:
    """(path, md5) of whole files of any size: a task goes through its files chunk by chunk, so no file is ever a value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for path in batch.column(0).to_pylist():
                system, at = _file_system(path)
                digest = hashlib.md5()
                with system.open_input_stream(at, compression=None) as src:
                    while data := src.read(chunk):
                        digest.update(data)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.string())], ["path", "md5"])

    return _dealt(list_files(spark, pattern), "path").mapInArrow(run, "path string, md5 string")


def range_digests(spark: SparkSession, pattern: str, size: int = 64 << 20, chunk: int = 8 << 20) -> DataFrame:
    """(path, length, ranges, digest): the md5 of the md5 of each range of ``size`` bytes, in order.

    For files too long for one task to go through: ranges are dealt over tasks, and a file is one row of its ranges'
    digests.  It is compared with digests made the same way, not with a plain md5."""
    parts = list_files(spark, pattern).withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(length - 1, 0) div {size}"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for path, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                system, at = _file_system(path)
                digest, left = hashlib.md5(), size
                with system.open_input_file(at) as src:
                    src.seek(n * size)
                    while left and (data := src.read(min(chunk, left))):
                        digest.update(data)
                        left -= len(data)
                sums.append(digest.digest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.binary())], ["path", "length", "n", "md5"])

    done = _dealt(parts, "path", "n").mapInArrow(run, "path string, length bigint, n bigint, md5 binary")
    whole = done.groupBy("path", "length").agg(F.sort_array(F.collect_list(F.struct("n", "md5"))).alias("r"))
    joined = F.aggregate("r", F.lit(b""), lambda a, x: F.concat(a, x["md5"]))
    return whole.select("path", "length", F.size("r").alias("ranges"), F.md5(joined).alias("digest"))


def _dealt(files: DataFrame, *by: str) -> DataFrame:
    """Rows that each cost much dealt over all tasks, whatever few bytes they have."""
    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(n, *by)


def checksum_diff(actual: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """OK / MISMATCH / MISSING (listed, not there) / EXTRA (there, not listed) per object."""
    a = actual.select(F.col(key).alias("_k"), F.col("md5").alias("_actual"))
    m = manifest.select(F.col(key).alias("_mk"), F.col("md5").alias("_listed"))
    status = (
        F.when(F.col("_mk").isNull(), "EXTRA")
        .when(F.col("_k").isNull(), "MISSING")
        .when(F.col("_actual") == F.col("_listed"), "OK")
        .otherwise("MISMATCH")
    )
    return a.join(m, F.col("_k") == F.col("_mk"), "full").select(
        F.coalesce("_k", "_mk").alias(key), status.alias("status")
    )


def ensure_column(df: DataFrame, name: str, default: Column) -> DataFrame:
    """The column exists and is never null: added or back-filled with the default."""
    current = F.coalesce(F.col(name), default) if name in df.columns else default
    return df.withColumn(name, current)


def read_generations(spark: SparkSession, path: str, defaults: dict[str, Column]) -> DataFrame:
    """Parquet files written with different columns in one read: every column any of them has, those of ``defaults``
    added where none has them and back-filled where a file lacks them or a row holds null.

    A column that is null in spite of that (a default that isn't a value) fails the read instead of passing on."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    for name, default in defaults.items():
        df = ensure_column(df, name, default)
        df = df.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"column '{name}' is null after back-fill"))).otherwise(F.col(name)))
    return df
