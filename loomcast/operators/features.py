"""Feature columns, targets, ordered splits and the business-day forecast frame."""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from loomcast.functions.expr import ratio
from loomcast.functions.series import Axis, Blocks, join_stats, lay_out

#: The default lags and windows of the feature set.
LAGS = (1, 2, 3, 5, 10)
WINDOWS = (5, 10, 20, 60, 120)
RETURNS = (1, 5)


def feature_names(lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS) -> list[str]:
    return [
        *[f"lag_{k}" for k in lags],
        *[c for w in windows for c in (f"sma_{w}", f"vol_{w}")],
        *[f"returns_{k}d" for k in RETURNS],
    ]


def feature_blocks(
    bars: DataFrame, lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS, axis: Axis = Axis()
) -> Blocks:
    """All features and the target on one layout: one shuffle, one sort."""
    back = max(*lags, *[w - 1 for w in windows], *RETURNS)
    b = lay_out(bars, axis, back, 1)
    cols: dict[str, Column] = {f"lag_{k}": b.lag("close", k) for k in lags}
    for w in windows:
        cols[f"sma_{w}"] = b.roll(F.avg, "close", w)
        cols[f"vol_{w}"] = b.roll(F.stddev_samp, "close", w)
    for k in RETURNS:
        cols[f"returns_{k}d"] = ratio("close", b.lag("close", k)) - 1
    cols["target"] = b.lead("close")
    return b.add(cols).own()


def make_features(
    bars: DataFrame, lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS, axis: Axis = Axis(),
    keep_unlabelled: bool = False, observed: Observation | None = None,
) -> DataFrame:
    """Features and target per row; rows with a null feature (warm-up) are dropped, and
    rows without a target (the last of a series) unless asked for.

    ``observed`` is given the rows seen (``rows``), kept (``samples``) and dropped, counted
    while the frame is first used: no pass of their own."""
    df = feature_blocks(bars, lags, windows, axis).rows()
    need = feature_names(lags, windows)
    need = need if keep_unlabelled else [*need, "target"]
    if observed is not None:
        whole = reduce(lambda a, c: a & F.col(c).isNotNull(), need, F.lit(True))
        df = df.observe(
            observed, F.count(F.lit(1)).alias("rows"), F.count(F.when(whole, 1)).alias("samples"),
            F.count(F.when(~whole, 1)).alias("dropped"))
    return df.dropna("any", subset=need)


def feature_counts(
    bars: DataFrame, lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS, axis: Axis = Axis()
) -> DataFrame:
    """Per series: number of features, usable samples, rows dropped."""
    need = [*feature_names(lags, windows), "target"]
    df = feature_blocks(bars, lags, windows, axis).rows()
    ok = F.lit(True)
    for c in need:
        ok = ok & F.col(c).isNotNull()
    return df.groupBy(*axis.key).agg(
        F.lit(len(need) - 1).alias("features"),
        F.count(F.when(ok, 1)).alias("samples"),
        F.count(F.when(~ok, 1)).alias("dropped"),
    )


def feature_block(bars: DataFrame, block: Mapping, axis: Axis = Axis()) -> DataFrame:
    """A declared block {name, params}: MovingAverage(window, normalize) or
    ExponentialSmoothing(alpha, adjust)."""
    name, params = block["name"], block.get("params", {})
    if name == "MovingAverage":
        return moving_average(bars, int(params.get("window", 30)), bool(params.get("normalize", True)), axis)
    if name == "ExponentialSmoothing":
        return exponential_smoothing(bars, float(params.get("alpha", 0.2)), bool(params.get("adjust", False)), axis)
    raise ValueError(f"unknown feature block '{name}'")


def moving_average(bars: DataFrame, window: int, normalize: bool = True, axis: Axis = Axis()) -> DataFrame:
    """The moving average, or close over it minus one."""
    b = lay_out(bars, axis, window - 1)
    sma = b.roll(F.avg, "close", window)
    return b.add({"ma": ratio("close", sma) - 1 if normalize else sma}).rows()


def exponential_smoothing(
    bars: DataFrame, alpha: float, adjust: bool = False, axis: Axis = Axis()
) -> DataFrame:
    """e = (1-alpha)·e_prev + alpha·x; with ``adjust`` the weighted mean of all rows so far.

    alpha 1 gives the value itself, alpha 0 the first value (adjusted: the plain mean).
    """
    if not 0.0 <= alpha <= 1.0:
        raise ValueError("alpha is 0..1")
    if alpha == 0.0:
        if adjust:
            known = F.when(F.col("close").isNotNull(), 1).otherwise(0).cast("long")
            b = lay_out(bars, axis).running_sum({"_s": F.col("close"), "_n": known})
            return b.add({"smooth": F.try_divide("_s", "_n")}).drop("_s", "_n").rows()
        at = F.struct(axis.order, *axis.tie)
        known = F.when(F.col("close").isNotNull(), at)
        first = bars.groupBy(*axis.key).agg(F.min_by("close", known).alias("_first"), F.min(known).alias("_from"))
        return join_stats(bars, first, axis.key).withColumn("smooth", F.when(at >= F.col("_from"), F.col("_first"))).drop("_first", "_from")
    if alpha == 1.0:
        return bars.withColumn("smooth", F.col("close"))
    b = lay_out(bars, axis)
    if not adjust:
        return b.ema({"smooth": ("close", alpha)}).rows()
    # Sum of weighted values over sum of weights, n rows into the series:
    #   (e_n - q^n·x_0) / (1 - q^n), q = 1 - alpha
    # where e is seeded with x_0; q^n·x_0 and q^n are EMAs too, of a value followed by zeros.
    there = F.col("close").isNotNull()
    b = b.running_sum({"_k": F.when(there, 1).otherwise(0).cast("long")})
    first = there & (F.col("_k") == 1)
    b = b.add({"_x0": F.when(first, F.col("close")).when(there, 0.0), "_one": F.when(first, 1.0).when(there, 0.0)})
    b = b.ema({"_e": ("close", alpha), "_dx": ("_x0", alpha), "_d1": ("_one", alpha)}, like="close")
    q = 1.0 - alpha
    smooth = (F.col("_e") - q * F.col("_dx")) / (1 - q * F.col("_d1"))
    return b.add({"smooth": smooth}).drop("_e", "_dx", "_d1", "_x0", "_one", "_k").rows()


# -- splits ------------------------------------------------------------------

def split_ordered(
    df: DataFrame, train: float = 0.7, valid: float = 0.1, axis: Axis = Axis()
) -> DataFrame:
    """Chronological split per series: the first int(n·train) rows, int(n·valid) rows, the rest.

    The ratios stay DOUBLE, so the products round the way float64 does.
    """
    if not 0 < train < 1 or not 0 <= valid < 1 or train + valid >= 1:
        raise ValueError("need 0 < train < 1, 0 <= valid < 1 and train + valid < 1")
    b = lay_out(df, axis).number("rn")
    if b.split:
        n = b.df.groupBy(*axis.key).agg(F.max("rn").alias("_n"))
        out = join_stats(b.rows(), n, axis.key)
    else:
        out = b.add({"_n": F.count(F.lit(1)).over(Window.partitionBy(*b.part))}).rows()
    n_train = F.floor(F.col("_n") * F.lit(float(train)))
    n_valid = F.floor(F.col("_n") * F.lit(float(valid)))
    split = (
        F.when(F.col("rn") <= n_train, "train")
        .when(F.col("rn") <= n_train + n_valid, "valid")
        .otherwise("test")
    )
    return out.withColumn("split", split).drop("rn", "_n")


def fit_rows(df: DataFrame) -> DataFrame:
    """Training and validation rows together."""
    return df.where(F.col("split").isin("train", "valid"))


def union_rows(parts: Iterable[DataFrame]) -> DataFrame:
    """Row union by column name."""
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def last_n(df: DataFrame, n: int, axis: Axis = Axis()) -> DataFrame:
    """The last n rows of each series; only n rows per series and map task are shuffled."""
    desc = Window.partitionBy(*axis.key).orderBy(*[F.desc(c) for c in (axis.order, *axis.tie)])
    return df.withColumn("_d", F.row_number().over(desc)).where(F.col("_d") <= n).drop("_d")
