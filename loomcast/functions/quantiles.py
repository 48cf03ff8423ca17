"""Exact quantiles per group, also for groups far too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcast.functions.series import join_on, longest_series, settle

#: Groups up to this many rows use the built-in exact aggregate (one map per group).
DIRECT_ROWS = 1 << 17
#: Accuracy of the sketch that brackets a quantile: rank error at most rows/SKETCH.
SKETCH = 10_000

#: Equal-width bins a bracket is counted in.
BINS = 4_096


def exact_quantiles(
    df: DataFrame, key: tuple[str, ...], col: str, probs: dict[str, float], max_rows: int | None = None,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """One row per group with a column per entry of ``probs`` (linear interpolation).

    For large groups a sketch (bounded memory, combined map-side) gives a value range
    that must hold the wanted ranks; exact counts below it and per bin inside it lead to
    the two neighbouring values.  No step brings a group's values into one task.
    """
    df = df.where(F.col(col).isNotNull())
    longest = max_rows if max_rows is not None else longest_series(df, key)
    if longest <= direct_rows:
        return df.groupBy(*key).agg(*[F.percentile(col, F.lit(p)).alias(n) for n, p in probs.items()])

    # sketch error (1/SKETCH) and the step to the next rank: 2 rows and more in groups
    # above SKETCH rows; smaller groups are looked at whole
    slack = 3.0 / SKETCH
    small = F.col("_n") <= SKETCH
    bounds = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(col).alias("_min"),
        F.max(col).alias("_max"),
        *[_bracket(col, p, slack).alias(f"_b_{n}") for n, p in probs.items()],
    )
    bounds = settle(bounds)
    groups = bounds.count()
    rank = {n: F.lit(p) * (F.col("_n") - 1) for n, p in probs.items()}
    lo = {n: F.when(small | F.lit(p <= slack), F.col("_min")).otherwise(F.col(f"_b_{n}")[0]) for n, p in probs.items()}
    hi = {n: F.when(small | F.lit(p >= 1 - slack), F.col("_max")).otherwise(F.col(f"_b_{n}")[1]) for n, p in probs.items()}

    # Value counts first: equal values collapse map-side, a hot group spreads by value.
    values = df.groupBy(*key, F.col(col).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    known = join_on(values, bounds, key, rows=groups)
    below = known.groupBy(*key).agg(
        *[F.coalesce(F.sum(F.when(F.col("_x") < lo[n], F.col("_c"))), F.lit(0)).alias(f"_u_{n}") for n in probs]
    )
    # Only values inside a bracket go on, one row per bracket they lie in.
    hits = F.array_compact(F.array(*[
        F.when(F.col("_x").between(lo[n], hi[n]), F.struct(
            F.lit(n).alias("name"), rank[n].alias("rank"),
            F.coalesce(F.floor(F.try_divide(F.col("_x") - lo[n], hi[n] - lo[n]) * BINS), F.lit(0)).alias("bin"),
        )) for n in probs
    ]))
    inside = known.select(*key, "_x", "_c", F.explode(hits).alias("_h")).select(*key, "_x", "_c", "_h.*")
    # The bracket of a huge group is still large: count it in bins of equal width and keep
    # only the (at most two) bins that hold the wanted ranks.
    bins = inside.groupBy(*key, "name", "rank", "bin").agg(F.sum("_c").alias("_c"))
    bins = join_on(bins, settle(below), key, rows=groups)
    under = F.lit(0)
    for n in probs:
        under = F.when(F.col("name") == n, F.col(f"_u_{n}")).otherwise(under)
    upto = Window.partitionBy(*key, "name").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("_to", under + F.sum("_c").over(upto)).withColumn("_from", F.col("_to") - F.col("_c"))
    held = bins.where((F.col("_from") <= F.ceil("rank")) & (F.col("_to") > F.floor("rank")))
    held = settle(held.select(*key, "name", "bin", "_from"))
    inside = join_on(inside, held, (*key, "name", "bin"), rows=held.count())
    run = Window.partitionBy(*key, "name", "bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_end", F.col("_from") + F.sum("_c").over(run)).withColumn("_start", F.col("_end") - F.col("_c"))

    def at(r: Column) -> Column:
        return F.max(F.when((F.col("_start") <= r) & (r < F.col("_end")), F.col("_x")))

    lower, upper = at(F.floor("rank")), at(F.ceil("rank"))
    frac = F.max(F.col("rank") - F.floor("rank"))
    picked = inside.groupBy(*key, "name").agg((lower + frac * (upper - lower)).alias("_v"))
    return picked.groupBy(*key).agg(*[F.max(F.when(F.col("name") == n, F.col("_v"))).alias(n) for n in probs])


def _bracket(col: str, p: float, slack: float) -> Column:
    lo, hi = max(0.0, p - slack), min(1.0, p + slack)
    return F.percentile_approx(col, [lo, hi], SKETCH)
