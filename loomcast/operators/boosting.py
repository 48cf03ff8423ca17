"""Gradient-boosted trees, one model per series, all series at once.

Features are cut into bins at quantiles of their series.  A level of the trees of all series is one pass: sums of
gradients per (series, node, feature, bin) are combined map-side, so that a hot series costs each task no more rows than
there are bins, and the best split of a node comes from running sums over its bins.  A leaf is the mean of its residuals
(squared loss), their median (absolute loss), or the median and the mean of what is left, clipped (huber); medians come
from mergeable sketches.  No series is gathered in one task; what goes back to the rows is one row per series, broadcast
while that is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcast.functions.series import join_on, settle

#: Accepted loss names, old and new.
LOSSES = {
    "ls": "squared", "lad": "absolute", "huber": "huber", "squared_error": "squared", "absolute_error": "absolute",
}
#: share of the residuals that huber doesn't clip
UNCLIPPED = 0.9
#: values a sketch of quantiles tells apart
RANKS = 10_000
#: trees after which predictions are written and their lineage cut
WRITE_EVERY = 10
#: a bin above all others: everything goes left
ALL = 127


def _median(c: Column) -> Column:
    return F.percentile_approx(c, 0.5, RANKS)


def bin_edges(rows: DataFrame, features: Sequence[str], key: Sequence[str], bins: int) -> DataFrame:
    """(key, edges): for each feature the distinct values at the quantiles i/bins of its series."""
    cuts = [i / bins for i in range(1, bins)]
    return rows.groupBy(*key).agg(
        F.array(*[F.array_distinct(F.percentile_approx(F.col(f).cast("double"), cuts, RANKS)) for f in features]).alias("edges")
    )


def _weight(numbers: int) -> int:
    """How many plain rows a row with so many numbers counts for, when the size of a broadcast is checked."""
    return 1 + numbers // 8


def _binned(features: Sequence[str]) -> Column:
    """The bin of each feature: how many edges lie below the value."""
    at = lambda i, f: F.size(F.filter(F.col("edges")[i], lambda e: e < F.col(f).cast("double"))).cast("tinyint")
    return F.array(*[at(i, f) for i, f in enumerate(features)])


def _walk(feature: Column, cut: Column, depth: int) -> Column:
    """Node (1 is the root, 2n and 2n+1 the children of n) that a row reaches after ``depth`` splits."""
    node = F.lit(1)
    for _ in range(depth):
        right = F.get(F.col("_bins"), F.get(feature, node - 1)) > F.get(cut, node - 1)
        node = node * 2 + right.cast("int")
    return node


def _splits(rows: DataFrame, key: Sequence[str], level: int) -> DataFrame:
    """(key, s): the best (feature, bin) of each node of a level; a node without a split sends everything left.

    The best split lowers the squared error of the gradients most; of equal ones the first feature, then the lowest
    bin."""
    first, nodes = 2**level, range(2**level, 2 ** (level + 1))
    hist = rows.select(*key, "_node", "_g", F.posexplode("_bins").alias("_f", "_b")).groupBy(*key, "_node", "_f", "_b").agg(
        F.sum("_g").alias("_sum"), F.count(F.lit(1)).alias("_n")
    )
    whole = Window.partitionBy(*key, "_node", "_f")
    run = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    left, n_left = F.sum("_sum").over(run), F.sum("_n").over(run)
    every, n = F.sum("_sum").over(whole), F.sum("_n").over(whole)
    hist = hist.select(
        *key, "_node", "_f", "_b", left.alias("_l"), n_left.alias("_nl"), (every - left).alias("_r"), (n - n_left).alias("_nr"),
    ).where("_nr > 0")
    gain = (F.col("_l") / F.col("_nl") - F.col("_r") / F.col("_nr")) ** 2 * F.col("_nl") * F.col("_nr") / (F.col("_nl") + F.col("_nr"))
    # sums of the same rows in another order differ in their last digits: nine digits decide, then the order of features
    scale = F.pow(F.lit(10.0), F.lit(8) - F.floor(F.log10(F.greatest(gain, F.lit(1e-290)))))
    hist = hist.withColumn("_gain", gain).withColumn("_gain", F.round(gain * scale) / scale).where("_gain > 1e-24")
    best = hist.groupBy(*key).agg(*[
        F.max(F.when(F.col("_node") == k, F.struct("_gain", (-F.col("_f")).alias("f"), (-F.col("_b").cast("int")).alias("b")))).alias(f"s{k - first}")
        for k in nodes
    ])
    stay = F.struct(F.lit(0).alias("f"), F.lit(ALL).alias("b"))
    take = lambda c: F.when(c.isNotNull(), F.struct((-c["f"]).alias("f"), (-c["b"]).alias("b"))).otherwise(stay)
    return best.select(*key, F.array(*[take(F.col(f"s{i}")) for i in range(len(nodes))]).alias("_s"))


def fit_per_series(
    rows: DataFrame, features: Sequence[str], label: str, key: Sequence[str] = ("symbol",), loss: str = "ls",
    iterations: int = 100, max_depth: int = 3, step: float = 0.1, bins: int = 32,
) -> DataFrame:
    """(key, edges, start, trees): a model for every series of ``rows``.

    Rows with a null key, label or feature teach nothing; a series without other rows has no model.  Rows that are
    repeated count as often as they stand there.  A series of equal labels gets trees without splits."""
    if loss not in LOSSES:
        raise ValueError(f"unsupported loss '{loss}', known: {', '.join(LOSSES)}")
    if not 2 <= bins <= ALL:
        raise ValueError(f"bins are 2..{ALL}")
    kind = LOSSES[loss]
    rows = rows.select(*key, *dict.fromkeys([*features, label])).dropna()
    first = F.avg(label) if kind == "squared" else _median(F.col(label).cast("double"))
    edges = bin_edges(rows, features, key, bins)
    stats = settle(edges.join(rows.groupBy(*key).agg(first.cast("double").alias("start")), list(key)))
    series = stats.count()
    data = join_on(rows, stats, key, rows=series * _weight(len(features) * bins)).select(
        *key, _binned(features).alias("_bins"), F.col(label).cast("double").alias("_y"), F.col("start").alias("_p")
    )
    data = data.checkpoint()
    trees = []
    for t in range(iterations):
        tree = settle(_tree(data, stats.select(*key), key, kind, max_depth, series)).withColumn("_t", F.lit(t))
        trees.append(tree)
        values, node = F.col("v"), _walk(F.col("f"), F.col("b"), max_depth) - 2**max_depth
        data = join_on(data, tree.drop("_t"), key, rows=series).select(
            *key, "_bins", "_y", (F.col("_p") + step * F.coalesce(F.get(values, node), F.lit(0.0))).alias("_p")
        )
        if (t + 1) % WRITE_EVERY == 0 and t + 1 < iterations:
            data = data.checkpoint()
    if not trees:
        return stats.withColumn("trees", F.array().cast("array<struct<_t:int,f:array<int>,b:array<int>,v:array<double>>>"))
    every = trees[0]
    for tree in trees[1:]:
        every = every.unionByName(tree)
    scaled = F.transform("v", lambda v: F.coalesce(v * step, F.lit(0.0))).alias("v")
    every = every.select(*key, F.struct("_t", "f", "b", scaled).alias("one"))
    # as many rows a series as there are iterations
    return settle(stats.join(every.groupBy(*key).agg(F.array_sort(F.collect_list("one")).alias("trees")), list(key)))


def _tree(data: DataFrame, known: DataFrame, key: Sequence[str], kind: str, depth: int, series: int) -> DataFrame:
    """(key, f, b, v): features, bins and leaf values of one tree for each series in ``known``.

    Every level is settled, a row per series: the next one reads it instead of going through the rows again."""
    left = data.withColumn("_res", F.col("_y") - F.col("_p"))
    if kind == "squared":
        left = left.withColumn("_g", F.col("_res"))
    elif kind == "absolute":
        left = left.withColumn("_g", F.signum("_res"))
    else:
        width = left.groupBy(*key).agg(F.percentile_approx(F.abs("_res"), UNCLIPPED, RANKS).alias("_width"))
        left = join_on(left, settle(width), key, rows=series)
        left = left.withColumn("_g", F.signum("_res") * F.least(F.abs("_res"), F.col("_width")))
    cols = left.columns
    tree = None
    for level in range(depth):
        if tree is None:
            at = left.withColumn("_node", F.lit(1))
        else:
            at = join_on(left, tree, key, rows=series).select(*cols, _walk(F.col("_s.f"), F.col("_s.b"), level).alias("_node"))
        here = _splits(at, key, level)
        stay = F.array(*[F.struct(F.lit(0).alias("f"), F.lit(ALL).alias("b"))] * 2**level)
        if tree is None:
            tree = settle(join_on(known, here, key, "left", series).select(*key, F.coalesce("_s", stay).alias("_s")))
        else:
            here = here.withColumnRenamed("_s", "_more")
            tree = settle(join_on(tree, here, key, "left", series).select(*key, F.concat("_s", F.coalesce("_more", stay)).alias("_s")))
    at = join_on(left, tree, key, rows=series).select(*cols, _walk(F.col("_s.f"), F.col("_s.b"), depth).alias("_node"))
    if kind == "squared":
        leaf = at.groupBy(*key, "_node").agg(F.avg("_res").alias("_v"))
    else:
        leaf = at.groupBy(*key, "_node").agg(_median(F.col("_res")).alias("_v"))
    if kind == "huber":
        off = F.col("_res") - F.col("_v")
        clipped = F.signum(off) * F.least(F.abs(off), F.col("_width"))
        leaf = join_on(at, leaf, [*key, "_node"], rows=series * 2**depth).groupBy(*key, "_node").agg(
            (F.max("_v") + F.avg(clipped)).alias("_v")
        )
    values = leaf.groupBy(*key).agg(
        F.array(*[F.max(F.when(F.col("_node") == k, F.col("_v"))) for k in range(2**depth, 2 ** (depth + 1))]).alias("v")
    )
    return join_on(values, tree, key, rows=series).select(*key, F.col("_s.f").alias("f"), F.col("_s.b").alias("b"), "v")


def predict_per_series(
    rows: DataFrame, model: DataFrame, features: Sequence[str], key: Sequence[str] = ("symbol",), out: str = "y_pred",
    max_depth: int = 3,
) -> DataFrame:
    """``rows`` of the series that have a model, with ``out``; null where a feature is null."""
    widest = model.agg(F.max(F.size("trees") * 2 ** (max_depth + 1) + F.size(F.flatten("edges"))), F.count(F.lit(1))).first()
    joined = join_on(rows, model, key, rows=widest[1] * _weight(widest[0] or 0)).withColumn("_bins", _binned(features))
    add = lambda acc, t: acc + F.get(t["v"], _walk(t["f"], t["b"], max_depth) - 2**max_depth)
    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull()
    value = F.aggregate("trees", F.col("start"), add)
    return joined.withColumn(out, F.when(known, value)).drop("_bins", "edges", "start", "trees")
