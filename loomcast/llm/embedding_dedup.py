"""Near-duplicate vectors by Euclidean p-stable hashing, followed by exact cosine checks.

Vectors are normalised; several tables of quantised random projections deal them into buckets, and only vectors that
share a bucket (and a label) are compared, in double precision.  Equal vectors are one node with a weight.  Buckets are
worked off in blocks of bounded size, pairs of blocks each by its own task, and what leaves a task is a count per vector
and a spanning forest of its links: never the pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm.common import components, narrow_join, settle


@dataclass(frozen=True)
class Hashing:
    """``tables`` tables of ``hashes`` projections each, quantised to ``width``.

    A projection puts unit vectors at distance c into one cell with probability p(c/width); at a cosine of 0.98
    (c = 0.2) and width 2 that is 0.92, for 14 projections 0.31, so 32 tables miss a pair on the threshold with a
    probability of 7e-6.  Orthogonal vectors meet in a table with a probability of 4e-5."""

    tables: int = 32
    hashes: int = 14
    width: float = 2.0
    seed: int = 97
    #: vectors of a bucket that one task takes as a block
    block: int = 1000


def projections(dim: int, h: Hashing) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rnd = np.random.default_rng([h.seed, dim])
    a = rnd.standard_normal((dim, h.tables * h.hashes))
    return a, rnd.uniform(0, h.width, h.tables * h.hashes), rnd.integers(1, 2**62, h.hashes, dtype=np.int64) * 2 + 1


def bucket_ids(x: np.ndarray, h: Hashing) -> np.ndarray:
    """(vectors, tables) 32-bit bucket numbers of normalised vectors."""
    a, shift, mul = projections(x.shape[1], h)
    cells = np.floor((x @ a + shift) / h.width).astype(np.int64).reshape(len(x), h.tables, h.hashes)
    mixed = (cells * mul).sum(axis=2)
    mixed ^= mixed >> 29
    mixed *= np.int64(-4658895280553007687)
    return (mixed >> 32).astype(np.int32)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    x = v.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def signed(nodes: DataFrame, h: Hashing) -> DataFrame:
    """``nodes`` (nid, dim, vec, ...) with ``sig``, the bucket in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(batch.schema.names.index("vec"))
            sizes = np.diff(vecs.offsets.to_numpy())
            sig = np.zeros((len(sizes), h.tables), np.int32)
            for d in set(sizes.tolist()):
                at = np.flatnonzero(sizes == d)
                sig[at] = bucket_ids(_unit(_matrix(vecs.take(pa.array(at)))), h)
            ends = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * h.tables)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(ends, pa.array(sig.ravel()))], [*batch.schema.names, "sig"]
            )

    fields = ", ".join(f"{n} {t}" for n, t in nodes.dtypes)
    return nodes.mapInArrow(run, f"{fields}, sig array<int>")


class _Forest:
    """Spanning links of positions 0 to n-1, found by union."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _pair(t: int, nid, weight, x, sig, side, threshold: float) -> tuple[dict, list]:
    """Counts and forest of one pair of blocks (or one block with itself) of a bucket of table ``t``."""
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    same = len(left) == len(nid)
    near = x[left] @ x[right].T >= threshold
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    i, j = left[i], right[j]
    if t:  # a pair counts in the first table where it meets
        first = np.ones(len(i), bool)
        for s in range(0, len(i), 65_536):
            first[s : s + 65_536] = ~(sig[i[s : s + 65_536], :t] == sig[j[s : s + 65_536], :t]).any(axis=1)
        i, j = i[first], j[first]
    counts = np.bincount(i, weight[j], len(nid)) + np.bincount(j, weight[i], len(nid))
    forest, kept = _Forest(len(nid)), []
    for a, b in zip(i.tolist(), j.tolist()):
        if forest.join(a, b):
            kept.append((int(nid[a]), int(nid[b])))
    return {int(n): int(c) for n, c in zip(nid, counts) if c}, kept


def compared(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows (key..., t, side, nid, weight, vec, sig), partitioned and sorted by the keys, to rows (a, b, n): links
    n = 0, and counts of links of a = b."""
    keys = ["label", "t", "bucket", "dim", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(group: pa.Table) -> tuple[dict, list]:
            g = group.combine_chunks()
            col = lambda c: g.column(c).combine_chunks().to_numpy(zero_copy_only=False)
            x = _unit(_matrix(g.column("vec").combine_chunks()))
            return _pair(int(g["t"][0].as_py()), col("nid"), col("weight"), x, _matrix(g.column("sig").combine_chunks()), col("side"), threshold)

        def out(found: list[tuple[dict, list]]) -> pa.RecordBatch:
            a, b, n = [], [], []
            for counts, links in found:
                a += [*counts, *(x for x, _ in links)]
                b += [*counts, *(y for _, y in links)]
                n += [*counts.values(), *([0] * len(links))]
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b, n)], ["a", "b", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.Table.from_batches([*held, batch])
            change = np.zeros(both.num_rows, bool)
            for k in keys:
                v = both.column(k).to_numpy()
                change[1:] |= v[1:] != v[:-1]
            starts = [0, *np.flatnonzero(change).tolist()]
            found = [finish(both.slice(s, e - s)) for s, e in zip(starts, starts[1:]) if e - s > 1]
            held = both.slice(starts[-1]).to_batches()
            if found:
                yield out(found)
        if held:
            last = pa.Table.from_batches(held)
            if last.num_rows > 1:
                yield out([finish(last)])

    return rows.mapInArrow(run, "a bigint, b bigint, n bigint")


def near_vectors(
    vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label",
    threshold: float = 0.98, h: Hashing = Hashing(),
) -> DataFrame:
    """One row per row of ``vecs``: the id, ``n_links`` (other rows linked directly), ``component_id`` (the smallest id
    that links reach) and ``kept`` (whether that is its own).

    Rows are linked when their labels are equal and not null and their cosine is ``threshold`` or more, computed in
    double precision from the given components; vectors of different lengths have none.  Rows whose vector or label is
    null, or whose vector is empty, zero or holds a null, NaN or infinity, and rows without id, link with nothing.  Ids
    may repeat; an empty table gives an empty result; other columns aren't read."""
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    src = vecs.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("vec"), label.alias("_l"))
    good = "vec IS NOT NULL AND size(vec) > 0 AND forall(vec, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))"
    good += " AND exists(vec, v -> v <> 0) AND _l IS NOT NULL AND _id IS NOT NULL"
    src = src.withColumn("_ok", F.coalesce(F.expr(good), F.lit(False)))
    alike = src.where("_ok").groupBy("_l", "vec").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    alike = alike.withColumns({"nid": F.monotonically_increasing_id(), "dim": F.size("vec")})
    nodes = settle(alike, "vectors")
    sigs = settle(signed(nodes.select("nid", "weight", F.col("_l").alias("label"), "dim", "vec"), h), "signed")
    keys = ["label", "t", "bucket", "dim"]
    places = sigs.select("label", "dim", "nid", F.posexplode("sig").alias("t", "bucket"))
    full = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    full = settle(full.withColumn("blocks", F.ceil(F.col("m") / h.block).cast("int")), "buckets")
    longest = nodes.agg(F.max(F.octet_length("_l"))).first()[0] or 0
    member = settle(narrow_join(places, full.drop("m"), keys, row_bytes=40 + longest), "members")
    mine = F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = member.withColumn("mine", mine).select(*keys, "nid", "mine", other)
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select(*keys, "nid", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), side.alias("side"))
    rows = dealt.join(sigs.select("nid", "weight", "vec", "sig"), "nid")
    group = [*keys, "lo", "hi"]
    found = settle(compared(rows.repartition(*group).sortWithinPartitions(*group), threshold), "found")
    counts = found.where("n > 0").groupBy(F.col("a").alias("nid")).agg(F.sum("n").alias("others"))
    groups = components(found.where("n = 0"))
    named = narrow_join(groups, nodes.select(F.col("nid").alias("node"), "rep"), ["node"], row_bytes=40)
    least = settle(named.groupBy("component").agg(F.min("rep").alias("least")), "least")
    of_node = narrow_join(named.select("node", "component"), least, ["component"], row_bytes=40).select(F.col("node").alias("nid"), "least")
    known = nodes.select("_l", "vec", "nid", "rep", "weight").join(of_node, "nid", "left").join(counts, "nid", "left")
    known = known.select("_l", "vec", F.coalesce("least", "rep").alias("least"), (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("links"))
    known = settle(known.withColumn("_ok", F.lit(True)), "classes")
    dims = 8 * 64 + 60
    out = narrow_join(src, known, ["_ok", "_l", "vec"], "left", dims)
    own = F.coalesce("least", "_id")
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
        F.col("_id").eqNullSafe(own).alias("kept"),
    )
