"""Near-equal lines by a segment-partition edit join.

A line within ``edits`` edits of another shares one of its edits + 1 segments with it unchanged, shifted by at most as
many places.  Each distinct line is indexed by its segments and probes the segments of lines as long as itself or a
little shorter with the few substrings that the lengths allow.  Lines that meet under a key are compared in blocks
inside tasks: first the parities of their byte counts, which must not differ by more than the edits can explain, then,
for lines that have a partner left, a banded bit-parallel edit distance.  What leaves a task is a count for each line
and a forest of links, never the pairs.  Lengths and edits count UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.llm.common import by_cell, components, key_filter, maybe_in, narrow_join, settle

#: lines below this many bytes are never taken out of a text: a few edits make another line of them
SHORTEST = 16
#: lines of one side of a cell, and their bytes
BLOCK = 1_000
BLOCK_BYTES = 8 << 20
CELL = ("key", "i", "x", "y")


def within(x: bytes, y: bytes, edits: int) -> bool:
    """Whether at most ``edits`` insertions, deletions and replacements lead from ``x`` to ``y``.

    Only the band of 2 * edits + 1 diagonals is looked at.  For each number of errors so far, the bits of an integer
    say which diagonals can be reached; a byte moves all diagonals at once."""
    if abs(len(x) - len(y)) > edits:
        return False
    n = min(len(x), len(y))
    head = 0
    while head < n and x[head] == y[head]:
        head += 1
    x, y = x[head:], y[head:]
    tail, n = 0, min(len(x), len(y))
    while tail < n and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    if tail:
        x, y = x[:-tail], y[:-tail]
    band = (1 << (2 * edits + 1)) - 1
    where: dict[int, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << (i + edits)  # bit o of this, shifted by j, is place j + o - edits of x
    reached = [(((1 << (e + 1)) - 1) << edits) & band for e in range(edits + 1)]
    for j, c in enumerate(y):
        same = where.get(c, 0) >> j & band
        below = 0  # reached with one error less: before this byte, and after it
        after = 0
        for e in range(edits + 1):
            now = reached[e] & same
            if e:
                now |= below | below >> 1 | (after << 1) & band
            below, after = reached[e], now
            reached[e] = now
        if not after:
            return False
    goal = len(x) - len(y) + edits
    return bool(reached[edits] >> goal & 1)


def segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Place (from 0) and size of segment i of a line of ``length``: the first ones are the shorter."""
    n = edits + 1
    size = F.floor(length / n)
    long = length % n  # so many of the last segments have one byte more
    extra = F.greatest(F.lit(0), F.lit(i - n) + long)
    return (size * i + extra).cast("int"), (size + F.when(F.lit(i) >= F.lit(n) - long, 1).otherwise(0)).cast("int")


def _key(line: Column, length: Column, i: int, start: Column, size: Column) -> Column:
    return F.struct(F.lit(i).alias("i"), F.xxhash64(F.lit(i), length, F.substring(line, start + 1, size)).alias("key"))


def index_keys(line: Column, length: Column, edits: int) -> Column:
    return F.array(*[_key(line, length, i, *segment(length, i, edits)) for i in range(edits + 1)])


def shifts(i: int, shorter: int, edits: int) -> range:
    """Places by which segment i of a line may be shifted in one that is ``shorter`` bytes longer: the edits left of
    the segment and right of it both have to fit."""
    return range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1)


def probe_keys(line: Column, length: Column, edits: int) -> Column:
    """Keys under which lines of the same length or up to ``edits`` bytes shorter may be indexed if they are near."""
    keys = []
    for shorter in range(edits + 1):
        other = length - shorter
        for i in range(edits + 1):
            start, size = segment(other, i, edits)
            for shift in shifts(i, shorter, edits):
                at = start + shift
                keys.append(F.when((other > 0) & (at >= 0) & (at + size <= length), _key(line, other, i, at, size)))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def meeting(x: bytes, y: bytes, edits: int) -> int | None:
    """The first segment of ``x`` under which it meets ``y``, which is as long or longer."""
    size, long = divmod(len(x), edits + 1)
    start = 0
    for i in range(edits + 1):
        n = size + (i >= edits + 1 - long)
        for shift in shifts(i, len(y) - len(x), edits):
            at = start + shift
            if at >= 0 and at + n <= len(y) and y[at : at + n] == x[start : start + n]:
                return i
        start += n
    return None


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.posexplode(F.split(text, "\n")).alias("_at", "_line"))


def parities(column: pa.Array) -> np.ndarray:
    """For each text 32 bits: whether the bytes of each class, by their lowest five bits, are odd in number.  An edit
    changes one or two of them."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    out = np.zeros(len(column), np.uint32)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        used = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
        bits = np.left_shift(np.uint32(1), (used & 31).astype(np.uint32))
        out[full] = np.bitwise_xor.reduceat(bits, at[full] - at[0])
    return out.view(np.int32)


def marked(lines: DataFrame) -> DataFrame:
    """``lines`` with ``sig``, their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = pa.array(parities(batch.column(batch.schema.names.index("_line"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, sig], [*batch.schema.names, "sig"])

    return lines.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in lines.dtypes) + ", sig int")


def _candidates(cell: pa.Table, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (indexed line, probing line) of one cell whose lengths and parities allow a link; of equal lengths the
    line of the smaller number is the indexed one."""
    col = lambda c: cell.column(c).to_numpy()
    nid, size, sig = col("nid"), col("size"), col("sig").view(np.uint32)
    probing = col("probing").astype(bool)
    left, right = np.flatnonzero(~probing), np.flatnonzero(probing)
    for at in range(0, len(left), 256):
        i = left[at : at + 256]
        more = size[right][None, :] - size[i][:, None]
        ok = (np.bitwise_count(sig[i][:, None] ^ sig[right][None, :]) <= 2 * edits) & (more <= edits)
        ok &= (more > 0) | ((more == 0) & (nid[i][:, None] < nid[right][None, :]))
        x, y = np.nonzero(ok)
        yield i[x], right[y]


def _partners(cell: pa.Table, edits: int) -> pa.Table:
    """The members of a cell that may have a link in it."""
    has = np.zeros(cell.num_rows, bool)
    for x, y in _candidates(cell, edits):
        has[x] = has[y] = True
    return cell.filter(pa.array(has))


def _links(cell: pa.Table, edits: int) -> pa.Table:
    """Rows (a, n): links that line a has in this cell, and (a, b): a forest of them.  A pair that meets under several
    segments counts under the first."""
    nid, i = cell.column("nid").to_pylist(), cell.column("i")[0].as_py()
    line = cell.column("b").to_pylist()
    count: dict[int, int] = {}
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while up.setdefault(v, v) != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    forest = []
    for xs, ys in _candidates(cell, edits):
        for x, y in zip(xs.tolist(), ys.tolist()):
            if within(line[x], line[y], edits) and meeting(line[x], line[y], edits) == i:
                a, b = nid[x], nid[y]
                count[a] = count.get(a, 0) + 1
                count[b] = count.get(b, 0) + 1
                p, q = root(a), root(b)
                if p != q:
                    up[q] = p
                    forest.append((a, b))
    a = [*count, *[a for a, _ in forest]]
    b = [None] * len(count) + [b for _, b in forest]
    n = [*count.values()] + [None] * len(forest)
    return pa.table([pa.array(c, pa.int64()) for c in (a, b, n)], names=["a", "b", "n"])


def _cells(index: DataFrame, probe: DataFrame) -> DataFrame:
    """Indexed and probing lines (i, key, nid, size, sig) that meet somebody, dealt to cells (key, i, x, y) of one block
    of either side each.  A key joins only with the one row that tells how many lines it has."""
    keys = ["key", "i"]
    known = index.groupBy(*keys).agg(F.count(F.lit(1)).alias("many"), F.min("nid").alias("lo"), F.min("size").alias("short"))
    hits = probe.join(known, keys).where("size > short OR nid > lo").select(*keys, "nid", "size", "sig", "many")
    hits = settle(hits, "hits")
    per = settle(hits.groupBy(*keys).agg(F.max("many").alias("many"), F.count(F.lit(1)).alias("probes"), F.max("size").alias("most")), "keys")
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / F.col("most"))))
    per = per.select(*keys, F.ceil(F.col("many") / block).cast("int").alias("xs"), F.ceil(F.col("probes") / block).cast("int").alias("ys"))
    h = F.xxhash64("nid")
    rest = ["nid", "size", "sig"]
    left = narrow_join(index, per, keys, row_bytes=40).select(
        *keys, F.pmod(h, F.col("xs")).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("y"), *rest, F.lit(0).alias("probing"))
    right = narrow_join(hits, per, keys, row_bytes=40).select(
        *keys, F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x"), F.pmod(h, F.col("ys")).cast("int").alias("y"), *rest, F.lit(1).alias("probing"))
    return left.unionByName(right)


def near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, shortest: int = 1) -> DataFrame:
    """One row per distinct line of all texts: ``id_col`` (smallest id of a row that has it), ``line``, ``n_rows`` (how
    often it stands in the texts), ``n_links`` (other lines within ``edits`` edits), ``class_id`` and ``class_line``
    (the line that stands for all that links reach: of the smallest id, of equals the least line), ``kept``.

    Lines end at a line feed; lines of less than ``shortest`` bytes, the empty line always, link with nothing.  Segments
    of lines below ``edits`` + 1 bytes are empty in part, so these meet all lines as short as they are.  Null texts are one empty
    line; lines whose rows have no id have a null one and come last; ids may repeat; an empty table gives an empty
    result; other columns aren't read.  Equal lines are counted map-side and compared once; very long lines are compared
    whole, in smaller blocks."""
    if edits < 0 or shortest < 1:
        raise ValueError("edits must not be negative, and the empty line links with nothing")
    lines = split_lines(docs, id_col, text_col).groupBy("_line").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("n_rows"))
    lines = marked(lines.withColumns({"nid": F.monotonically_increasing_id(), "size": F.octet_length("_line")}))
    lines = settle(lines, "lines", "zstd")
    some = lines.where(F.col("size") >= shortest).withColumn("b", F.col("_line").cast("binary"))

    def keyed(keys: Column) -> DataFrame:
        return some.select(F.explode(keys).alias("k"), "nid", "size", "sig").select("k.key", "k.i", "nid", "size", "sig")

    # probing lines look for lines of the least length too: those below it aren't indexed
    cells = _cells(keyed(index_keys(F.col("b"), F.col("size"), edits)), keyed(probe_keys(F.col("b"), F.col("size"), edits)))
    shape = "key bigint, i int, x int, y int, nid bigint, size int, sig int, probing int"
    found = settle(by_cell(cells, CELL, lambda c: _partners(c, edits), shape), "partners")
    texts = settle(maybe_in(some.select("nid", "b"), "nid", key_filter(found, "nid")), "texts")
    out = settle(by_cell(found.join(texts, "nid"), CELL, lambda c: _links(c, edits), "a bigint, b bigint, n bigint"), "links")
    counts = out.where("n IS NOT NULL").groupBy(F.col("a").alias("nid")).agg(F.sum("n").alias("n_links"))
    links = out.where("b IS NOT NULL").select("a", "b")
    groups = components(links).withColumnRenamed("node", "nid")
    named = settle(groups.join(counts, "nid").join(lines.select("nid", "_id", F.col("_line").alias("l")), "nid"), "named")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "l")).alias("f"))
    found = named.select("nid", "component", "n_links").join(first, "component").select(
        "nid", "n_links", F.col("f._id").alias("class_id"), F.col("f.l").alias("class_line")
    )
    out = narrow_join(lines, settle(found, "classes"), ["nid"], "left", 500)
    alone = F.col("n_links").isNull()
    line = F.when(alone, F.col("_line")).otherwise(F.col("class_line"))
    return out.select(
        F.col("_id").alias(id_col), F.col("_line").alias("line"), "n_rows", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("_id")).otherwise(F.col("class_id")).alias("class_id"), line.alias("class_line"), (F.col("_line") == line).alias("kept"),
    )


def without_near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with ``text_col`` rebuilt without lines that stand for a kept one: of each class of lines the first
    place (least id, rows without id last; then row and place) stays, lines shorter than ``shortest`` always stay.

    Rows are told apart by numbers of their own, so ids may be null or repeat; every row comes back once, a null text
    as empty, other columns as they are; an empty table gives none."""
    rows = settle(docs.withColumn("_nr", F.monotonically_increasing_id()), "rows")
    classes = near_lines(rows, id_col, text_col, edits, shortest).select(F.col("line").alias("_line"), "class_line")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    places = rows.select("_nr", F.col(id_col).alias("_id"), F.posexplode(F.split(text, "\n")).alias("_at", "_line")).join(classes, "_line")
    short = F.octet_length("_line") < shortest
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "_nr", "_at")
    firsts = places.where(~short).groupBy("class_line").agg(F.min(place).alias("f")).select(
        "class_line", F.col("f._nr").alias("_nr"), F.col("f._at").alias("_at"), F.lit(True).alias("_first"))
    kept = places.join(firsts, ["class_line", "_nr", "_at"], "left").where(short | F.coalesce("_first", F.lit(False)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_line"))), lambda s: s["_line"]), "\n")
    whole = kept.groupBy("_nr").agg(joined.alias("_new"))
    out = rows.join(whole, "_nr", "left")
    return out.select(*[F.coalesce("_new", F.lit("")).alias(c) if c == text_col else F.col(c) for c in docs.columns])
