"""Exact de-duplication: 128-bit content hashes, bytes compared inside groups, one stable row of each group stays."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.llm.common import key_filter, maybe_in, narrow_join, settle


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None, hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of ``docs``: the id, ``keep_id`` (the smallest or largest id of the equal texts),
    ``group_size``, ``kept`` and ``text_sha256`` of the normalised text.

    Texts are equal when their bytes are: rows are grouped by a 128-bit hash first, and only groups of two or more are
    read again and grouped by the text itself, so that unequal texts of one hash are told apart.  Groups are counted
    map-side: copies of one text, however many, meet as one row per task, and single texts are never shuffled.

    Null texts count as empty; a null id is never kept unless no id of the group is known, then ``keep_id`` is null and
    all its rows stay; rows with equal id and text are marked alike; an empty table gives an empty result; other
    columns of ``docs`` are not looked at."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("_id"), (normalise(text) if normalise else text).alias("_t"))
    rows = settle(src.select("_id", hashed(F.col("_t")).alias("_h"), F.unhex(F.sha2("_t", 256)).alias("_s")), "hashes")
    several = settle(rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"), "several")
    suspects = maybe_in(src.withColumn("_h", hashed(F.col("_t"))), "_h", key_filter(several, "_h"))
    equal = suspects.groupBy("_h", "_t").agg(best("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    equal = settle(
        equal.where("group_size > 1").select("_h", F.unhex(F.sha2("_t", 256)).alias("_s"), "keep_id", "group_size"), "equal"
    )
    out = narrow_join(rows, equal, ["_h", "_s"], "left", 100)
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("_id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("_id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("_s")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns kept; of rows equal in id and text one stays.

    What goes is told by (id, text hash); the rows that are compared leave the others untouched."""
    marks = exact_groups(docs, id_col, text_col, keep).where("group_size > 1")
    gone = settle(
        marks.groupBy(F.col(id_col).alias("_gid"), F.col("text_sha256").alias("_gs")).agg(
            F.bool_or("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows")
        ).where("NOT _kept OR _rows > 1"),
        "copies",
    )
    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    marked = docs.withColumns({"_gid": F.col(id_col), "_gs": sha})
    cond = [marked["_gid"].eqNullSafe(gone["_gid"]), marked["_gs"] == gone["_gs"]]
    small = gone.count() * 100 <= 4 << 20
    rest = marked.join(F.broadcast(gone) if small else gone, cond, "left_anti").drop("_gid", "_gs")
    twice = gone.where("_kept")
    if twice.isEmpty():
        return rest
    again = marked.join(twice, cond, "left_semi").dropDuplicates(["_gid", "_gs"]).drop("_gid", "_gs")
    return rest.unionByName(again)
