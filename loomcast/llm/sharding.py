"""Shards by balanced label propagation, with DataFrame functions only.

Linked documents (those of one group, e.g. equal texts) are pulled together: in each round every group that isn't whole
yet votes with its members for a shard that can still take all of it, and groups move there as far as the quota allows.
Large groups go first, and rounds go on until no shard can take a waiting group.  Members of a group that are in the
same shard are alike, so a round works on the counts of (group, shard), at most one row per group and shard: a group of
a third of all rows is a few dozen rows for each shard it fills.  Documents without links then fill what is free, which
makes the counts exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcast.llm.common import narrow_join, number, settle

#: groups down to this part of the largest waiting one vote in the same round
CLASS = 4
#: hash buckets by which a shard takes what wishes to come
BUCKETS = 4096


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard, at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _lookup(values: list[int], key) -> Column:
    """A value for each shard, as a column: one entry per shard, so its size is fixed."""
    return F.get(F.array(*[F.lit(int(v)) for v in values]).cast("array<bigint>"), key)


def _votes(waiting: DataFrame, free: list[int], top: int, step: int) -> DataFrame:
    """(g, c, size, to, bucket): each group of at most ``top`` rows votes for the shard that has most of its members of
    those that can take it whole (of equals told by a hash); where none can, for a shard told by a hash in proportion to
    what is free there."""
    shards, key = len(free), ["g", "c"]
    turn = F.pmod(F.xxhash64(*key, F.lit(step)), F.lit(shards))
    weight = F.col("n") * shards + F.pmod(F.col("shard") + turn, F.lit(shards))
    fits = _lookup(free, F.col("shard")) >= F.col("size")
    best = waiting.where(f"size <= {top} AND size * {CLASS} >= {top}").groupBy(*key, "size").agg(F.max(F.when(fits, weight)).alias("_v"))
    ends, at = [], 0
    for f in free:
        at += f if f >= top else 0
        ends.append(at)
    drawn = F.pmod(F.xxhash64(F.lit(step), *key), F.lit(at))
    other = F.size(F.filter(F.array(*[F.lit(e) for e in ends]).cast("array<bigint>"), lambda e: e <= drawn))
    to = F.coalesce(F.pmod(F.col("_v") % shards - turn, F.lit(shards)), other).cast("int")
    return best.select(*key, "size", to.alias("to"), F.pmod(F.xxhash64(*key, F.lit(-1 - step)), F.lit(BUCKETS)).cast("int").alias("bucket"))


def propagate(start: DataFrame, quota: list[int]) -> tuple[DataFrame, DataFrame, list[int]]:
    """From rows (g, c, shard, n, size) of groups (g, c) of ``size`` rows, n of them in ``shard``: the groups that are
    whole (g, c, shard), those left (g, c, size), and the rows that each shard has free.

    A shard takes what votes for it by hash buckets, new ones each round, up to what is free.  When the rounds end, each
    group left is larger than what any shard has free, so there are fewer groups left than shards.  Only numbers per
    shard come to the driver."""
    free, waiting, step, whole = list(quota), start, 0, []
    while True:
        top = waiting.where(F.col("size") <= max(free)).agg(F.max("size")).first()[0]
        if not top:
            break
        votes = settle(_votes(waiting, free, top, step), "votes")
        sums = votes.groupBy("to", "bucket").agg(F.sum("size").alias("n"))
        sums = sums.withColumn("n", F.sum("n").over(W.partitionBy("to").orderBy("bucket")))
        fit = sums.where(F.col("n") <= _lookup(free, F.col("to"))).groupBy("to").agg(F.max("bucket").alias("bucket"), F.max("n").alias("n"))
        upto = [-1] * len(free)
        for r in fit.collect():
            upto[r["to"]] = r["bucket"]
            free[r["to"]] -= r["n"]
        step += 1
        if max(upto) < 0:
            continue  # groups of one bucket were in each other's way: the next round deals them anew
        comes = votes.where(F.col("bucket") <= _lookup(upto, F.col("to"))).select("g", "c", F.col("to").alias("shard"))
        whole.append(comes)
        waiting = settle(waiting.join(comes.select("g", "c"), ["g", "c"], "left_anti"), "waiting")
    placed = start.select("g", "c", "shard").limit(0)
    for comes in whole:
        placed = placed.unionByName(comes)
    return settle(placed, "placed"), settle(waiting.select("g", "c", "size").distinct(), "left"), free


def assign_shards(docs: DataFrame, shards: int, group: list[str]) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0, gapless in each shard).

    The counts of rows of any two shards differ by at most one.  Rows equal in the columns ``group`` are linked.  A group
    stays in one shard unless it is larger than a quota (then it fills whole shards and its rest stays together) or no
    shard has room left for it.  Rows with a null in ``group`` are linked with nothing.  ``docs`` must be settled and
    have a column ``_u`` that is unique, such as ``monotonically_increasing_id`` written with it; ids may be null or
    repeated.  An empty table gives an empty result."""
    total = docs.count()
    quota = quotas(total, shards)
    links = docs.where(" AND ".join(f"{c} IS NOT NULL" for c in group)).groupBy(*group).agg(F.count(F.lit(1)).alias("_members"))
    links = settle(links.where("_members > 1").withColumn("g", F.monotonically_increasing_id()), "groups")
    named = narrow_join(docs.select("_u", *group), links, group, "left", 60)
    member = settle(named.select("_u", "g", "_members"), "members")
    linked, single = member.where("g IS NOT NULL"), member.where("g IS NULL").select("_u")
    n_linked = linked.count()
    # every linked row starts in a shard told by a hash, then groups propagate; no part is larger than a quota
    part = max(1, quota[-1])
    spread = number(settle(linked, "linked"), ["g"], ["_u"], "_all", n_linked)
    spread = spread.withColumns({"c": F.expr(f"_all div {part}"), "_at": F.expr(f"_all % {part}")})
    spread = settle(spread.withColumn("size", F.least(F.lit(part), F.col("_members") - F.col("c") * part)).drop("_all", "_members"), "spread")
    start = spread.groupBy("g", "c", "size", F.pmod(F.xxhash64("_u"), F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    placed, left, free = propagate(settle(start, "start"), quota)
    home = narrow_join(spread.select("_u", "g", "c"), placed, ["g", "c"]).select("_u", "shard")
    # groups left, fewer than shards, lie one after another over what is free, the emptiest shards first
    before = W.orderBy(F.desc("size"), "g", "c").rowsBetween(W.unboundedPreceding, -1)
    left = settle(left.withColumn("_from", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size"), "ranges")
    n_left = sum(quota) - sum(q - f for q, f in zip(quota, free)) - (total - n_linked)
    rest = narrow_join(spread.select("_u", "g", "c", "_at"), left, ["g", "c"]).select("_u", (F.col("_from") + F.col("_at")).alias("_r"))
    singles = number(settle(single.withColumn("_k", F.lit(0)), "singles"), ["_k"], ["_u"], "_r", total - n_linked)
    pool = rest.unionByName(singles.select("_u", (F.col("_r") + n_left).alias("_r")))
    order = sorted(range(shards), key=lambda s: -free[s])
    ends, at = [], 0
    for s in order:
        at += free[s]
        ends.append(at)
    behind = F.filter(F.array(*[F.lit(e) for e in ends]).cast("array<bigint>"), lambda e: e <= F.col("_r"))
    filled = pool.select("_u", _lookup(order, F.size(behind)).cast("int").alias("shard"))
    where = settle(home.unionByName(filled), "where")
    out = number(where, ["shard"], ["_u"], "slot", total)
    return docs.join(out, "_u")


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``size`` (UTF-8 bytes of the text, null none, plus 16), ``text_crc32``
    (unsigned), ``shard`` and ``slot``; equal texts are linked (null as empty) and stay together as far as shards with
    counts at most one apart allow.  Texts are read once and don't move, very long ones too; ids may be null or repeat; an
    empty table gives an empty result; other columns aren't read."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("_m"), F.xxhash64(text).alias("_x"),
    )
    rows = settle(rows.withColumn("_u", F.monotonically_increasing_id()), "rows")
    out = assign_shards(rows, shards, ["_m", "_x"])
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")


def cut_links(placed: DataFrame, group: list[str]) -> DataFrame:
    """(pairs, cut): linked pairs, and those whose ends are in different shards, from counts alone."""
    n = placed.groupBy(*group, "shard").agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy(*group).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    return per.agg(
        F.sum(F.col("all") * (F.col("all") - 1) / 2).cast("long").alias("pairs"), F.sum((F.col("all") * F.col("all") - F.col("sq")) / 2).cast("long").alias("cut")
    )
