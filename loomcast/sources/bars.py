"""Bar sources: reading, normalising, resampling."""

from __future__ import annotations

import datetime as dt
from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcast.functions.series import Axis, at_last, lay_out

BAR_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("adj_close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])
REQUIRED = ("open", "high", "low", "close", "volume")
#: The names of the supported bar frequencies.
FREQUENCIES = {"1d": "day", "1wk": "week", "1mo": "month"}
FORMATS = ("parquet", "orc", "csv", "json")


def read_bars(
    spark: SparkSession,
    path: str,
    source: str = "parquet",
    symbols: Iterable[str] | None = None,
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
    schema: T.StructType = BAR_SCHEMA,
) -> DataFrame:
    """Bars of some symbols in [start, end); the predicates reach the file scan."""
    if source not in FORMATS:
        raise ValueError(f"unknown bar source '{source}', known: {', '.join(FORMATS)}")
    reader = spark.read.schema(schema)
    if source == "csv":
        reader = reader.option("header", True)
    df = reader.format(source).load(path)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(list(symbols)))
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("ts") < F.lit(end))
    return df


def write_bars(bars: DataFrame, path: str) -> str:
    """Bars sorted by (symbol, ts) over range partitions: statistics then prune by symbol
    and time, and a hot symbol is cut by time into many files."""
    (
        bars.repartitionByRange("symbol", "ts")
        .sortWithinPartitions("symbol", "ts")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .parquet(path)
    )
    return path


def require_rows(df: DataFrame) -> DataFrame:
    """Raise when there are no bars (reads at most one row)."""
    if df.isEmpty():
        raise ValueError("no price data")
    return df


def normalise(df: DataFrame) -> DataFrame:
    """Flat lower-case column names, required columns present, rows without a close dropped."""
    names = {c: c.strip().lower().replace(" ", "_") for c in df.columns}
    df = df.withColumnsRenamed(names)
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    keep = [c for c in ("symbol", "ts", *REQUIRED[:4], "adj_close", "volume") if c in df.columns]
    return df.select(*keep).dropna(subset=["close"])


def to_bars(
    df: DataFrame, symbol: Column, ts: Column, price: Column, order: Column, volume: Column | None = None
) -> DataFrame:
    """Ticks to bars: first, highest, lowest, last price and volume per (symbol, ts).

    Everything is combined map-side; a hot symbol costs one row per map task and bar.
    """
    ticks = df.select(
        symbol.alias("symbol"), ts.alias("ts"), price.alias("_p"), order.alias("_o"),
        *([volume.alias("_v")] if volume is not None else []),
    )
    vol = F.sum("_v") if volume is not None else F.count(F.lit(1)).cast("double")
    return ticks.groupBy("symbol", "ts").agg(
        F.min_by("_p", "_o").alias("open"),
        F.max("_p").alias("high"),
        F.min("_p").alias("low"),
        F.max_by("_p", "_o").alias("close"),
        vol.alias("volume"),
    )


def resample(bars: DataFrame, freq: str) -> DataFrame:
    """Bars at a lower frequency ('1d', '1wk', '1mo'); the label is the period's first day."""
    if freq not in FREQUENCIES:
        raise ValueError(f"unknown frequency '{freq}', known: {', '.join(FREQUENCIES)}")
    period = F.to_date(F.date_trunc(FREQUENCIES[freq], F.col("ts").cast("timestamp")))
    extra = [F.max_by("adj_close", "ts").alias("adj_close")] if "adj_close" in bars.columns else []
    return bars.groupBy("symbol", period.alias("ts")).agg(
        F.min_by("open", bars["ts"]).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", bars["ts"]).alias("close"),
        *extra,
        F.sum("volume").alias("volume"),
    )


def adjust(bars: DataFrame) -> DataFrame:
    """Prices on the scale of the adjusted close (splits and dividends taken out); bars without one stay as they are."""
    k = F.coalesce(F.try_divide(F.col("adj_close"), F.col("close")), F.lit(1.0))
    scaled = {c: F.col(c) * k for c in ("open", "high", "low")}
    return bars.withColumns(scaled | {"close": F.coalesce("adj_close", "close")}).drop("adj_close")


def load_bars(
    spark: SparkSession, path: str, symbols: Iterable[str] | None, start, end, freq: str = "1d",
    auto_adjust: bool = True, source: str = "parquet",
) -> DataFrame:
    """Read, check, adjust and down-sample; an empty result is an error."""
    if freq not in FREQUENCIES:
        raise ValueError(f"unknown frequency '{freq}', known: {', '.join(FREQUENCIES)}")
    bars = require_rows(normalise(read_bars(spark, path, source, symbols, start, end)))
    if auto_adjust:
        bars = adjust(bars)
    bars = bars if freq == "1d" else resample(bars, freq)
    return bars.select("symbol", "ts", *REQUIRED)


def closes(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "ts", "close")


def latest_snapshot(bars: DataFrame, window: int = 5, axis: Axis = Axis()) -> DataFrame:
    """Last close of each symbol, its simple moving average, and the time of that bar."""
    b = lay_out(bars.select(*axis.key, axis.order, "close"), axis, lookback=window - 1)
    df = b.add({"sma": b.roll(F.avg, "close", window)}).rows()
    return df.groupBy(*axis.key).agg(*at_last(("close", "sma"), axis.order), F.max(axis.order).alias("as_of"))


def latest_row(df: DataFrame, axis: Axis = Axis()) -> DataFrame:
    """The last row of each series: a partial aggregate, no window."""
    rest = [c for c in df.columns if c not in axis.key]
    return df.groupBy(*axis.key).agg(*at_last(rest, axis.order, *axis.tie))
