"""Near-duplicate documents by MinHash bands, odd sketches and exact sets of word shingles.

One pass makes MinHash samples of every document.  Bands of samples give buckets of candidates; the samples folded
into a parity bitmap (an odd sketch) tell from the population count of an XOR how similar two candidates are, precisely
where similarity is high; what passes is confirmed on the full sets of shingles, which are made again for candidates
only.  Links are looked for where they can still change a group: first between members and ends of buckets, then, in
buckets that hold more than one group, between all members of different groups, in blocks inside the tasks: what
leaves them is a forest of links, never the pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcast.llm.common import components, key_filter, maybe_in, narrow_join, settle
from loomcast.llm.exact_dedup import content_hash
from loomcast.llm.pieces import texts_of

#: distinct words whose hashes a worker remembers
WORDS = 200_000
#: ends of buckets that each set is confirmed with before whole buckets are looked at
ENDS = 2
#: members of a bucket that a task takes as a block
BLOCK = 500
#: what members that meet in one task have in common
CELL = ["key", "t", "lo", "hi"]
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Shape:
    """Shingles of ``words`` words; ``samples`` MinHash samples, of which ``bands`` bands of ``rows`` make buckets and
    all make sketches of 64 * ``longs`` bits.

    With 32 bands of 4, a pair of similarity 0.75 shares no band with a probability of 5e-6.  ``slack`` is how far an
    estimate may lie below the threshold: an estimate from 512 samples in 2048 bits deviates by 0.021 there, so 0.10
    turns away one such pair in a million."""

    words: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    samples: int = 512
    longs: int = 32
    slack: float = 0.10

    @property
    def most_bits(self) -> int:
        """Bits by which the sketches of a pair that may pass differ at most."""
        n = 64 * self.longs
        odd = 2 * self.samples * (1 - max(0.0, self.percent / 100 - self.slack))
        return math.ceil(n / 2 * (1 - (1 - 2 / n) ** odd))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    """Hashes of words, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sets of hashed word shingles, their samples and sketches.  A to Z are taken as a to z; words are what stands
    between the ASCII white space characters."""

    def __init__(self, shape: Shape):
        self.shape, self.known = shape, _Words()
        rnd = np.random.default_rng(20_240_601)
        self.weights = rnd.integers(1, 2**63, shape.words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.xor = rnd.integers(0, 2**32, shape.samples, dtype=np.uint32)
        self.mul = rnd.integers(0, 2**31, shape.samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.cell = _mix(rnd.integers(0, 2**63, shape.samples, dtype=np.uint64))
        self.band = _mix(rnd.integers(0, 2**63, shape.bands, dtype=np.uint64))

    def hashes(self, text: str) -> np.ndarray:
        """The distinct shingles of a text, sorted; fewer words than a shingle has are one shingle; none are none."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > WORDS:
            self.known.clear()
        w = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        k = self.shape.words
        if len(w) < k:
            return np.array([xxhash.xxh3_64_intdigest(w.tobytes(), seed=len(w))], np.uint64)
        n = len(w) - k + 1
        h = w[:n] * self.weights[0]
        for i in range(1, k):
            h += w[i : n + i] * self.weights[i]
        return np.unique(_mix(h))

    def key(self, h: np.ndarray) -> tuple[int, int]:
        """128 bits that stand for the whole set."""
        return struct_pair(xxhash.xxh3_128_digest(h.tobytes()))

    def samples(self, h: np.ndarray) -> np.ndarray:
        x = (h >> np.uint64(32)).astype(np.uint32)
        out = np.full(self.shape.samples, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 256):
            np.minimum(out, ((x[i : i + 256, None] ^ self.xor) * self.mul).min(axis=0), out=out)
        return out

    def bands(self, m: np.ndarray) -> np.ndarray:
        g = m[: self.shape.bands * self.shape.rows].reshape(self.shape.bands, self.shape.rows).astype(np.uint64)
        h = self.band.copy()
        for i in range(self.shape.rows):
            h = _mix(h ^ g[:, i])
        return h.view(np.int64)

    def sketch(self, m: np.ndarray) -> np.ndarray:
        n = 64 * self.shape.longs
        at = (_mix(m.astype(np.uint64) ^ self.cell) % np.uint64(n)).astype(np.int64)
        return np.packbits((np.bincount(at, minlength=n) & 1).astype(np.uint8)).view(np.int64)


def struct_pair(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))


def signatures(docs: DataFrame, shape: Shape, id_col: str, text_col: str, hashed: bool = False) -> DataFrame:
    """(_id, n, s1, s2, bands, k0, k1, ...): size and 128-bit key of each set, its bands and its sketch; with
    ``hashed`` also ``th``, the hash of the text itself."""
    longs = [f"k{i}" for i in range(shape.longs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingler(shape)
        for batch in batches:
            sizes, keys, bands, sketches = [], [], [], []
            for text in texts_of(batch):
                h = sh.hashes(text)
                m = sh.samples(h)
                sizes.append(len(h))
                keys.append(sh.key(h))
                bands.append(sh.bands(m))
                sketches.append(sh.sketch(m))
            n = len(sizes)
            flat = pa.array(np.concatenate(bands) if n else np.empty(0, np.int64))
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * shape.bands)
            sk = np.stack(sketches) if n else np.empty((0, shape.longs), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()), pa.ListArray.from_arrays(ends, flat),
                    *(pa.array(np.ascontiguousarray(sk[:, i])) for i in range(shape.longs)), *batch.columns[2:],
                ],
                ["_id", "n", "s1", "s2", "bands", *longs, *batch.schema.names[2:]],
            )

    src = _source(docs, id_col, text_col)
    kind = src.schema["_id"].dataType.simpleString()
    more = ", ".join(f"{c} bigint" for c in longs)
    if hashed:
        src, more = src.withColumn("th", content_hash(F.col("_t"))), f"{more}, th binary"
    return src.mapInArrow(run, f"_id {kind}, n bigint, s1 bigint, s2 bigint, bands array<bigint>, {more}")


def shingle_sets(docs: DataFrame, shape: Shape, id_col: str, text_col: str) -> DataFrame:
    """(_id, s1, s2, hs): the full set of each document as sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingler(shape)
        for batch in batches:
            sets = [sh.hashes(t) for t in texts_of(batch)]
            keys = [sh.key(h) for h in sets]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), flat),
                ],
                ["_id", "s1", "s2", "hs"],
            )

    src = _source(docs, id_col, text_col)
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, s1 bigint, s2 bigint, hs array<bigint>")


class _Search:
    """The search for links between distinct sets, over settled tables.

    ``sets`` has one row per distinct set: nid, rep (smallest id), s1, s2, the bands and the sketch."""

    def __init__(self, docs: DataFrame, sets: DataFrame, shape: Shape, id_col: str, text_col: str):
        self.docs, self.sets, self.shape, self.id_col, self.text_col = docs, sets, shape, id_col, text_col
        self.longs = [f"k{i}" for i in range(shape.longs)]

    def sketched(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sketches allow the threshold, with the bits they differ by as ``d``."""
        sk = self.sets.select("nid", *self.longs)
        for side in ("a", "b"):
            names = [F.col(c).alias(f"{side}{c}") for c in self.longs]
            pairs = narrow_join(pairs, sk.select(F.col("nid").alias(side), *names), [side], row_bytes=280)
        pairs = pairs.withColumn("d", self.bits("a", "b"))
        return pairs.where(F.col("d") <= self.shape.most_bits).drop(*[f"{s}{c}" for s in "ab" for c in self.longs])

    def bits(self, a: str, b: str) -> Column:
        return F.expr(" + ".join(f"bit_count({a}{c} ^ {b}{c})" for c in self.longs))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that hold on their full sets; only the documents concerned are shingled again."""
        if pairs.isEmpty():
            return pairs.select("a", "b")
        full = self.full_sets(pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct())
        both = pairs.select("a", "b").join(full.select(F.col("nid").alias("a"), F.col("hs").alias("x")), "a")
        both = both.join(full.select(F.col("nid").alias("b"), F.col("hs").alias("y")), "b")
        both = both.withColumn("i", F.size(F.array_intersect("x", "y")))
        hold = both.where(F.col("i") * 100 >= (F.size("x") + F.size("y") - F.col("i")) * self.shape.percent)
        return settle(hold.select("a", "b").distinct(), "links")

    def links(self, buckets: DataFrame) -> DataFrame:
        """Links (a, b) that join the same groups as all links among the members of any bucket (key, t, nid)."""
        ends = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("nid").alias("lo"), F.max("nid").alias("hi"))
        members = settle(buckets.join(ends.where("m > 1").drop("m"), "key"), "buckets")
        stars = members.select("nid", F.explode(F.array("lo", "hi")).alias("end")).where("nid <> end")
        stars = stars.select(F.least("nid", "end").alias("a"), F.greatest("nid", "end").alias("b")).distinct()
        # each member tries the ends it resembles most, of the ends of its buckets
        nearest = Window.partitionBy("b").orderBy("d", "a")
        tried = self.sketched(stars).withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= ENDS)
        tried = settle(tried.select("a", "b"), "tried")
        links = self.confirmed(tried)
        return settle(links.unionByName(self.across(members.select("key", "t", "nid"), components(links))), "links")

    @staticmethod
    def named(df: DataFrame, groups: DataFrame, node: str, out: str) -> DataFrame:
        """``df`` with the group of its ``node`` column, the node itself where it has no link."""
        g = groups.select(F.col("node").alias(node), F.col("component").alias("_g"))
        return narrow_join(df, g, [node], "left", 40).withColumn(out, F.coalesce("_g", node)).drop("_g")

    def across(self, members: DataFrame, groups: DataFrame) -> DataFrame:
        """Links between different groups of one bucket: a spanning forest of them, never the pairs.

        In each bucket the members outside its largest group meet all others; members of that group, however many,
        don't meet each other.  Buckets are worked off in cells of two blocks.  A first pass over the sketches tells
        which members of a cell have a partner that may pass; only those bring their full sets to the second, which
        confirms pairs of groups that aren't joined yet."""
        m = self.named(members, groups, "nid", "g")
        sizes = m.groupBy("key", "g").agg(F.count(F.lit(1)).alias("c"))
        mixed = sizes.groupBy("key").agg(F.sum("c").alias("all"), F.max("c").alias("c"), F.max_by("g", "c").alias("main"), F.count(F.lit(1)).alias("groups"))
        mixed = settle(mixed.where("groups > 1").select("key", "main", "c", "all"), "mixed")
        if mixed.isEmpty():
            return members.select(F.col("nid").alias("a"), F.col("nid").alias("b")).limit(0)
        sketch = self.sets.select("nid", "bands", *self.longs)
        cells = self.cells(narrow_join(m, mixed, ["key"], row_bytes=40))
        found = settle(self.compared(cells.join(sketch, "nid"), sets=False).select(*CELL, F.col("a").alias("nid"), "side", "few", "g"), "partners")
        if found.isEmpty():
            return found.select(F.col("nid").alias("a"), F.col("nid").alias("b"))
        full = self.full_sets(found.select("nid").distinct())
        rows = found.join(sketch, "nid").join(full, "nid")
        return settle(self.compared(rows, sets=True).select("a", "b").distinct(), "links")

    @staticmethod
    def cells(m: DataFrame) -> DataFrame:
        """Members dealt to cells (key, lo, hi): blocks of the members outside the main group with each other and with
        those of that group.  A bucket of one block is one cell."""
        one = F.col("all") <= BLOCK
        few_blocks = F.when(one, 1).otherwise(F.ceil((F.col("all") - F.col("c")) / BLOCK)).cast("int")
        blocks = F.when(one, 1).otherwise(few_blocks + F.ceil(F.col("c") / BLOCK)).cast("int")
        m = m.withColumns({"few": F.col("g") != F.col("main"), "fb": few_blocks, "blocks": blocks})
        h = F.xxhash64("nid")
        mine = F.when(F.col("few") | one, F.pmod(h, F.col("fb"))).otherwise(F.col("fb") + F.pmod(h, F.greatest(F.col("blocks") - F.col("fb"), F.lit(1))))
        others = F.when(F.col("few"), F.col("blocks")).otherwise(F.col("fb"))
        m = m.withColumn("mine", mine.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), others.cast("int") - 1)))
        side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
        return m.select("key", "t", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "nid", side.alias("side"), "few", "g")

    def full_sets(self, nids: DataFrame) -> DataFrame:
        """(nid, hs): the full sets of the nodes, made again from the documents that stand for them."""
        need = settle(nids.join(self.sets.select("nid", "rep", "s1", "s2"), "nid"), "wanted")
        again = maybe_in(self.docs.select(F.col(self.id_col).alias("_id"), F.col(self.text_col).alias("_t")), "_id", key_filter(need, "rep"))
        found = shingle_sets(again, self.shape, "_id", "_t").withColumnRenamed("_id", "rep")
        # a node's row may stand in the table more than once
        return settle(narrow_join(found, need, ["rep", "s1", "s2"]).select("nid", "hs").dropDuplicates(["nid"]), "sets")

    def compared(self, rows: DataFrame, sets: bool) -> DataFrame:
        """Cells of members to rows (cell, a, b, side, few, g): with ``sets`` links, else the members with partners (as a).

        A pair counts in the first band in which the two share a bucket."""
        shape, longs = self.shape, self.longs

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def out(cell: pa.Table) -> pa.RecordBatch:
                cell = cell.combine_chunks()
                if sets:
                    pairs = _linked(cell, shape, longs)
                    row, a, b = [0] * len(pairs), [x for x, _ in pairs], [y for _, y in pairs]
                else:
                    row = _with_partner(cell, shape, longs)
                    a = b = cell.column("nid").to_numpy()[row]
                at = pa.array(row, pa.int64())
                cols = [cell.column(c).combine_chunks().take(at) for c in CELL]
                rest = [cell.column(c).combine_chunks().take(at) for c in ("side", "few", "g")]
                return pa.RecordBatch.from_arrays([*cols, pa.array(a, pa.int64()), pa.array(b, pa.int64()), *rest], [*CELL, "a", "b", "side", "few", "g"])

            for batch in batches:
                if not batch.num_rows:
                    continue
                both = pa.Table.from_batches([*held, batch])
                change = np.zeros(both.num_rows, bool)
                for k in CELL:
                    v = both.column(k).to_numpy()
                    change[1:] |= v[1:] != v[:-1]
                starts = [0, *np.flatnonzero(change).tolist()]
                for s, e in zip(starts, starts[1:]):
                    if e - s > 1:
                        yield out(both.slice(s, e - s))
                held = both.slice(starts[-1]).to_batches()
            if held:
                yield out(pa.Table.from_batches(held))

        columns = [*CELL, "nid", "side", "few", "g", "bands", *longs, *(["hs"] if sets else [])]
        dealt = rows.select(*columns).repartition(*CELL).sortWithinPartitions(*CELL)
        return dealt.mapInArrow(run, "key bigint, t int, lo int, hi int, a bigint, b bigint, side int, few boolean, g bigint")


def _candidates(cell: pa.Table, shape: Shape, longs: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of positions (i, j) of one cell that may pass, with the bits they differ by, some rows at a time."""
    col = lambda c: cell.column(c).to_numpy()
    side, few, g, t = col("side"), col("few").astype(bool), col("g"), int(cell.column("t")[0].as_py())
    sk = np.stack([col(c) for c in longs], axis=1).view(np.uint64)  # of negative numbers, bits of the amount are counted
    bands = cell.column("bands").combine_chunks().flatten().to_numpy().reshape(len(side), -1)[:, :t]
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    same = bool((side == 2).any())
    for at in range(0, len(left), 64):
        i = left[at : at + 64]
        d = np.zeros((len(i), len(right)), np.int32)
        for k in range(sk.shape[1]):
            d += np.bitwise_count(sk[i, k][:, None] ^ sk[right, k][None, :])
        ok = (d <= shape.most_bits) & (g[i][:, None] != g[right][None, :]) & (few[i][:, None] | few[right][None, :])
        if same:
            ok &= i[:, None] < right[None, :]
        x, y = np.nonzero(ok)
        far = d[x, y]
        x, y = i[x], right[y]
        first = ~(bands[x] == bands[y]).any(axis=1)
        yield x[first], y[first], far[first]


def _with_partner(cell: pa.Table, shape: Shape, longs: list[str]) -> np.ndarray:
    """Positions of the members of a cell that have a partner that may pass."""
    has = np.zeros(cell.num_rows, bool)
    for x, y, _ in _candidates(cell, shape, longs):
        has[x] = has[y] = True
    return np.flatnonzero(has)


def _linked(cell: pa.Table, shape: Shape, longs: list[str]) -> list[tuple[int, int]]:
    """Links of one cell that join groups, the most alike first; pairs of joined groups aren't looked at."""
    sets = cell.column("hs").combine_chunks()
    ends, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
    nid, g = cell.column("nid").to_numpy(), cell.column("g").to_numpy()
    names, of = np.unique(g, return_inverse=True)
    up = list(range(len(names)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    found = list(_candidates(cell, shape, longs))
    x, y, d = (np.concatenate([f[k] for f in found]) for k in range(3))
    size = np.diff(ends)[: len(nid)]
    fits = 100 * np.minimum(size[x], size[y]) >= shape.percent * np.maximum(size[x], size[y])
    x, y, d = x[fits], y[fits], d[fits]
    for k in np.argsort(d, kind="stable").tolist():
        i, j = int(x[k]), int(y[k])
        p, q = root(int(of[i])), root(int(of[j]))
        if p == q:
            continue
        both = np.concatenate((flat[ends[i] : ends[i + 1]], flat[ends[j] : ends[j + 1]]))
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        if 100 * shared >= shape.percent * (len(both) - shared):
            up[max(p, q)] = min(p, q)
            out.append((int(nid[i]), int(nid[j])))
    return out


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape(), hashed: bool = False
) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_shingles``, ``component_id`` (the smallest id that links reach) and
    ``kept`` (whether that is the row's own id); with ``hashed`` also ``th``, the hash of the row's text.

    Two documents are linked when 100 * intersection >= ``shape.percent`` * union of their sets of shingles.  Rows of
    equal sets are one node, so copies, however many, are never compared.  Null or wordless texts and rows without id
    are linked with nothing; ids may repeat, rows then get the component of their own text; an empty table gives an
    empty result; other columns aren't read.

    Nothing is collected: buckets, links and components are tables.  A bucket of very many near copies is looked at
    through its two ends and, where groups are left apart, from its smaller groups only."""
    sig = settle(signatures(docs, shape, id_col, text_col, hashed), "signatures")
    longs = [f"k{i}" for i in range(shape.longs)]
    real = sig.where("n > 0 AND _id IS NOT NULL")
    sets = real.groupBy("s1", "s2").agg(
        F.min("_id").alias("rep"), F.first("bands").alias("bands"), *[F.first(c).alias(c) for c in longs]
    )
    sets = settle(sets.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    buckets = sets.select(F.posexplode("bands").alias("t", "key"), "nid")
    links = _Search(docs, sets, shape, id_col, text_col).links(buckets)
    groups = components(links)
    named = narrow_join(groups, sets.select(F.col("nid").alias("node"), "rep"), ["node"], row_bytes=40)
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    of_set = narrow_join(named.select("node", "component"), settle(least, "least"), ["component"], row_bytes=40)
    of_set = of_set.select(F.col("node").alias("nid"), "least")
    known = sets.select("s1", "s2", "nid", "rep").join(of_set, "nid", "left")
    known = settle(known.select("s1", "s2", F.coalesce("least", "rep").alias("least")), "classes")
    linked = F.when(F.col("n").__gt__(0) & F.col("_id").isNotNull(), F.col("s1"))
    own_hash = ["th"] if hashed else []
    out = narrow_join(sig.select("_id", "n", linked.alias("s1"), "s2", *own_hash), known, ["s1", "s2"], "left", 60)
    own = F.coalesce("least", "_id")
    return out.select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("_id").eqNullSafe(own).alias("kept"),
        *own_hash,
    )


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape()) -> DataFrame:
    """``docs`` without the rows whose text is a near copy of a kept one: of each group the smallest id stays.  What
    goes is told by (id, text hash), so an id that stands on several texts loses only those that are near copies of a
    smaller id's; rows of one group that repeat its kept id stay."""
    marks = near_groups(docs, id_col, text_col, shape, hashed=True).where("NOT kept")
    gone = settle(marks.select(F.col(id_col).alias("_gone"), F.col("th").alias("_gone_th")).distinct(), "gone")
    small = gone.count() * 64 <= 4 << 20
    same = (docs[id_col] == gone["_gone"]) & (content_hash(docs[text_col].cast("string")) == gone["_gone_th"])
    return docs.join(F.broadcast(gone) if small else gone, same, "left_anti")
