"""Cleaning and scaling of series.

Statistics are fitted per group on a chosen part of the rows (``fit_on``), as map-side
combined aggregates of one row per group, and joined back (broadcast once counted).
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.functions.quantiles import exact_quantiles
from loomcast.functions.series import Axis, join_stats, lay_out

KEY = ("symbol",)


def _fit(df: DataFrame, fit_on: Column | None) -> DataFrame:
    return df if fit_on is None else df.where(fit_on)


def _stats(df: DataFrame, key, fit_on: Column | None, **aggs: Column) -> DataFrame:
    stats = _fit(df, fit_on).groupBy(*key).agg(*[c.alias(n) for n, c in aggs.items()])
    return join_stats(df, stats, key)


# -- missing values ----------------------------------------------------------

def drop_missing(df: DataFrame, cols: Sequence[str] = ("close",)) -> DataFrame:
    return df.dropna(subset=list(cols))


def fill_mean(df: DataFrame, col: str = "close", key=KEY, fit_on: Column | None = None) -> DataFrame:
    out = _stats(df, key, fit_on, _avg=F.avg(col))
    return out.withColumn(col, F.coalesce(col, "_avg")).drop("_avg")


def fill_previous(df: DataFrame, col: str = "close", axis: Axis = Axis()) -> DataFrame:
    """Last known value; leading nulls stay null."""
    return lay_out(df, axis).last_known({"_fill": F.col(col)}).rows().withColumn(col, F.col("_fill")).drop("_fill")


# -- outliers ----------------------------------------------------------------

def drop_sigma(df: DataFrame, col: str = "close", k: float = 3.0, key=KEY, fit_on: Column | None = None) -> DataFrame:
    """Keep values within k sample standard deviations of the mean (all, when there is no deviation)."""
    out = _stats(df, key, fit_on, _avg=F.avg(col), _sd=F.stddev_samp(col))
    keep = F.abs(F.col(col) - F.col("_avg")) <= F.lit(float(k)) * F.col("_sd")
    return out.where(F.coalesce(keep, F.col(col).isNotNull())).drop("_avg", "_sd")


def _quartiles(df: DataFrame, col: str, key, fit_on, max_rows: int | None) -> DataFrame:
    q = exact_quantiles(_fit(df, fit_on), key, col, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}, max_rows)
    return join_stats(df, q, key)


def drop_iqr(
    df: DataFrame, col: str = "close", k: float = 1.5, key=KEY, fit_on: Column | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Keep values within k interquartile ranges of the quartiles (exact quartiles)."""
    out = _quartiles(df, col, key, fit_on, max_rows)
    iqr = F.col("_q3") - F.col("_q1")
    keep = F.col(col).between(F.col("_q1") - k * iqr, F.col("_q3") + k * iqr)
    return out.where(keep).drop("_q1", "_q2", "_q3")


def zscore(
    df: DataFrame, col: str = "close", limit: float = 3.0, key=KEY, fit_on: Column | None = None
) -> DataFrame:
    """Columns ``z`` and ``outlier``."""
    out = _stats(df, key, fit_on, _avg=F.avg(col), _sd=F.stddev_samp(col))
    out = out.withColumn("z", F.try_divide(F.col(col) - F.col("_avg"), F.col("_sd"))).drop("_avg", "_sd")
    return out.withColumn("outlier", F.abs("z") > limit)


# -- scaling -----------------------------------------------------------------

def robust_scale(
    df: DataFrame, col: str = "close", key=KEY, fit_on: Column | None = None, max_rows: int | None = None,
    out: str = "scaled",
) -> DataFrame:
    """(value - median) / interquartile range."""
    df = _quartiles(df, col, key, fit_on, max_rows)
    return df.withColumn(out, F.try_divide(F.col(col) - F.col("_q2"), F.col("_q3") - F.col("_q1"))).drop(
        "_q1", "_q2", "_q3"
    )


def min_max(
    df: DataFrame, col: str = "close", lo: float = 0.0, hi: float = 1.0, key=KEY, fit_on: Column | None = None,
    out: str = "scaled",
) -> DataFrame:
    """Scale to [lo, hi]; a constant column becomes lo."""
    df = _stats(df, key, fit_on, _min=F.min(col), _max=F.max(col))
    unit = F.try_divide(F.col(col) - F.col("_min"), F.col("_max") - F.col("_min"))
    unit = F.when(F.col(col).isNotNull(), F.coalesce(unit, F.lit(0.0)))
    return df.withColumn(out, unit * (hi - lo) + lo).drop("_min", "_max")


def standardise(
    df: DataFrame, col: str = "close", key=KEY, fit_on: Column | None = None, out: str = "scaled"
) -> DataFrame:
    """(value - mean) / population standard deviation."""
    df = _stats(df, key, fit_on, _avg=F.avg(col), _sd=F.stddev_pop(col))
    return df.withColumn(out, F.try_divide(F.col(col) - F.col("_avg"), F.col("_sd"))).drop("_avg", "_sd")


# -- generated features ------------------------------------------------------

def polynomial(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Degree 2: all squares and pairwise products."""
    new = {}
    for i, a in enumerate(cols):
        for b in cols[i:]:
            new[f"{a}_x_{b}"] = F.col(a) * F.col(b)
    return df.withColumns(new)


def log_transform(df: DataFrame, col: str = "close", out: str = "log") -> DataFrame:
    return df.withColumn(out, F.when(F.col(col) > 0, F.ln(col)))


#: The Box-Cox exponents tried when none is given.
LAMBDAS = tuple(x / 2 for x in range(-4, 5))


def box_cox_value(x: Column, lam: Column | float) -> Column:
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    return F.when(x > 0, F.when(lam == 0, F.ln(x)).otherwise((F.pow(x, lam) - 1) / F.nullif(lam, F.lit(0.0))))


def box_cox_fit(
    df: DataFrame, col: str = "close", key=KEY, lambdas: Sequence[float] = LAMBDAS, fit_on: Column | None = None
) -> DataFrame:
    """Per group the exponent of highest log-likelihood.

    All exponents are aggregate columns of one pass: rows are not multiplied.
    """
    x = F.col(col)
    pos = _fit(df, fit_on).where(x > 0)
    sums = pos.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.ln(x)).alias("_log"),
        *[F.var_pop(box_cox_value(x, l)).alias(f"_v{i}") for i, l in enumerate(lambdas)],
    )
    best = F.array_max(F.array(*[
        F.when(F.col(f"_v{i}") > 0, F.struct(
            (-F.col("_n") / 2 * F.ln(f"_v{i}") + F.lit(l - 1.0) * F.col("_log")).alias("loglik"),
            F.lit(float(l)).alias("lam"),
        )) for i, l in enumerate(lambdas)
    ]))
    return sums.select(*key, best.alias("_b")).select(*key, "_b.lam", "_b.loglik")


def box_cox(
    df: DataFrame, col: str = "close", lam: float | None = None, key=KEY, fit_on: Column | None = None,
    out: str = "boxcox",
) -> DataFrame:
    if lam is not None:
        return df.withColumn(out, box_cox_value(F.col(col), lam))
    fitted = box_cox_fit(df, col, key, fit_on=fit_on).select(*key, F.col("lam").alias("_lam"))
    return join_stats(df, fitted, key).withColumn(out, box_cox_value(F.col(col), F.col("_lam"))).drop("_lam")


# -- dimension reduction -----------------------------------------------------

def pca(df: DataFrame, cols: Sequence[str], k: int = 5, prefix: str = "pc_") -> tuple[DataFrame, list[float]]:
    """The first k principal components over all rows, and the explained variance ratios.

    The covariance matrix is one distributed aggregate; only its columns-by-columns
    size reaches the driver.
    """
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    k = min(k, len(cols))
    rows = df.dropna(subset=list(cols))
    vec = VectorAssembler(inputCols=list(cols), outputCol="_x").transform(rows)
    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(vec)
    arr = vector_to_array("_pc")
    out = model.transform(vec).withColumns({f"{prefix}{i + 1}": arr[i] for i in range(k)}).drop("_x", "_pc")
    return out, [float(v) for v in model.explainedVariance]


# -- configuration -----------------------------------------------------------

#: Method names a plan may use.
MISSING = {"削除": "drop", "平均補完": "mean", "前日値で補完": "previous"}
OUTLIERS = {"なし": None, "3σ法": "sigma", "IQR法": "iqr", "Zスコア法": "zscore", "ロバストスケーリング法": "robust"}
SCALING = {"なし": None, "MinMaxスケーリング": "minmax", "標準化": "standard"}
GENERATED = {"なし": None, "多項式展開": "poly", "対数変換": "log", "Box-Cox変換": "boxcox"}


def preprocess(df: DataFrame, cfg: Mapping, col: str = "close", axis: Axis = Axis()) -> DataFrame:
    """Apply the enabled blocks of a plan's preprocessing section, in their fixed order."""

    def enabled(block: str, names: Mapping | None):
        section = cfg.get(block) or {}
        if section.get("enable", "Off") != "On":
            return []
        value = section.get("value", [])
        if names is None:
            return [value]
        bad = [v for v in value if v not in names]
        if bad:
            raise ValueError(f"unknown {block}: {bad}")
        return [names[v] for v in value if names[v]]

    key = axis.key
    steps = {
        "drop": lambda d: drop_missing(d, [col]),
        "mean": lambda d: fill_mean(d, col, key),
        "previous": lambda d: fill_previous(d, col, axis),
        "sigma": lambda d: drop_sigma(d, col, 3.0, key),
        "iqr": lambda d: drop_iqr(d, col, 1.5, key, max_rows=axis.max_rows),
        "zscore": lambda d: zscore(d, col, 3.0, key),
        "robust": lambda d: robust_scale(d, col, key, max_rows=axis.max_rows, out=f"{col}_robust"),
        "minmax": lambda d: min_max(d, col, key=key, out=f"{col}_minmax"),
        "standard": lambda d: standardise(d, col, key, out=f"{col}_std"),
        "poly": lambda d: polynomial(d, [col]),
        "log": lambda d: log_transform(d, col, f"{col}_log"),
        "boxcox": lambda d: box_cox(d, col, key=key, out=f"{col}_boxcox"),
    }
    for block, names in (
        ("missing_value_methods", MISSING), ("outlier_methods", OUTLIERS),
        ("scaling_methods", SCALING), ("feature_generation_methods", GENERATED),
    ):
        for step in enabled(block, names):
            df = steps[step](df)
    for v in enabled("Normalization", None):
        lo, hi = v.get("range", (0, 1))
        df = min_max(df, col, float(lo), float(hi), key, out=f"{col}_norm")
    for v in enabled("OutlierRemoval", None):
        df = drop_sigma(df, col, float(v.get("threshold", 3)), key)
    for v in enabled("dimensionality_reduction", None):
        if v.get("use_pca"):
            doubles = [c for c, t in df.dtypes if t == "double"]
            df, _ = pca(df, doubles, int(v.get("pca_components", 5)))
    return df
