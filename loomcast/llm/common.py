"""Helpers that several operators of this package share: settled tables, bounded filters, numbering, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcast.session import scratch

#: a lookup frame up to this many bytes, counted before, is broadcast; beyond it the join shuffles
BROADCAST_BYTES = 4 << 20
#: bits of the fixed-size filter that narrows a second scan (2 MB in all, whatever the input)
FILTER_BITS = 24
#: rows that one task numbers at a time
NUMBER_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to a new folder under the shared one and read it back: lineage is cut, work is done once,
    and a lost executor costs a read."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", row_bytes: int = 64) -> DataFrame:
    """Join a settled ``right`` of one row per key.  It is counted first: small, it is broadcast, and no key of
    ``left`` is shuffled; large, both sides shuffle and AQE splits the skewed partitions of ``left``."""
    if right.count() * row_bytes <= BROADCAST_BYTES:
        right = F.broadcast(right)
    return left.join(right, list(on), how)


def by_cell(rows: DataFrame, cell: Sequence[str], fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` over the rows of each cell, whose columns ``cell`` are whole numbers; the caller bounds the rows of a
    cell.  Cells of one row are left out: they have nobody to compare with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.Table.from_batches([*held, batch])
            change = np.zeros(both.num_rows, bool)
            for c in cell:
                v = both.column(c).to_numpy()
                change[1:] |= v[1:] != v[:-1]
            starts = [0, *np.flatnonzero(change).tolist()]
            done = [fn(both.slice(s, e - s).combine_chunks()) for s, e in zip(starts, starts[1:]) if e - s > 1]
            yield from (b for t in done for b in t.select(names).to_batches())
            held = both.slice(starts[-1]).to_batches()
        if held:
            yield from fn(pa.Table.from_batches(held).combine_chunks()).select(names).to_batches()

    names = [part.split()[0] for part in schema.split(", ")]
    return rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, schema)


def _word(col: str, bits: int):
    return F.expr(f"shiftrightunsigned(xxhash64({col}), {64 - bits + 6})")


def _mask(col: str):
    return F.expr(f"shiftleft(1L, CAST(xxhash64({col}) & 63 AS INT))")


def key_filter(keys: DataFrame, col: str, bits: int = FILTER_BITS) -> DataFrame:
    """A bitmap of hashed keys as rows (word, mask): at most 2^(bits-6) rows, so that its broadcast is bounded."""
    return keys.select(_word(col, bits).alias("_word"), _mask(col).alias("_mask")).groupBy("_word").agg(
        F.bit_or("_mask").alias("_mask")
    )


def maybe_in(df: DataFrame, col: str, flt: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``df`` whose key may be one of the filter's; whatever must be exact is joined afterwards."""
    hit = df.withColumns({"_word": _word(col, bits), "_bit": _mask(col)}).join(F.broadcast(flt), "_word")
    return hit.where("(_mask & _bit) <> 0").drop("_word", "_bit", "_mask")


def number(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, rows: int | None = None) -> DataFrame:
    """Gapless numbers from 0 within ``keys``, in an order that is fixed but has no meaning.

    A key of any size is dealt over hash buckets of the ``order`` columns: each bucket is numbered by its own task,
    and a bucket starts where the counts of the ones before it end.  ``df`` must be settled (it is read twice)."""
    rows = df.count() if rows is None else rows
    n = max(1, -(-rows // NUMBER_ROWS))
    d = df.withColumn("_b", F.expr(f"CAST(pmod(xxhash64({', '.join(order)}), {n}) AS INT)"))
    inside = d.withColumn("_i", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)) - 1)
    if n == 1:
        return inside.withColumn(out, F.col("_i").cast("long")).drop("_b", "_i")
    per = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = per.select(*keys, "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    return inside.join(starts, [*keys, "_b"]).withColumn(out, F.col("_start") + F.col("_i")).drop("_b", "_i", "_start", "_n")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of links between longs: rows (node, component), the component being its smallest node.

    Rounds of contraction: every node takes the least node within two links, in an order that changes each round,
    links are renamed and repeated ones dropped, until none is left.  Two links reach from leaf to leaf, so a node and
    all its neighbours, however many, are one after a round; of long chains a constant share of the nodes goes each
    round.  All of it is map-side combined sums and joins, so a node with very many links is no group in one task.
    The names of the rounds are joined once at the end.  Nodes without links are not returned."""
    masks = (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x1B873593CC9E2D51, 0x61C8864680B583EB)
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = settle(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    rounds: list[DataFrame] = []
    while not e.isEmpty():
        mask = masks[len(rounds) % len(masks)]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.expr(f"least(u ^ {mask}L, v ^ {mask}L)")).alias("m"))
        # a node is its neighbours' neighbour, so it has part in the least of theirs
        near = both.join(low.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("m").alias("m"))
        to = settle(near.select("u", F.expr(f"m ^ {mask}L").alias("to")), "names")
        rounds.append(to)
        left = e.join(to.select("u", F.col("to").alias("x")), "u")
        both = left.join(to.select(F.col("u").alias("v"), F.col("to").alias("y")), "v").where("x <> y")
        e = settle(both.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "links")
    if not rounds:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    names = None
    for to in reversed(rounds):  # the fewest names first
        here = to.select(F.col("u").alias("node"), F.col("to").alias("name"))
        if names is not None:
            later = names.select(F.col("node").alias("name"), F.col("name").alias("last"))
            here = here.join(later, "name", "left").select("node", F.coalesce("last", "name").alias("name"))
        names = here
    if len(rounds) > 1:
        names = settle(names, "names")
    least = names.groupBy("name").agg(F.min("node").alias("component"))
    return settle(names.join(least, "name").select("node", "component"), "components")
