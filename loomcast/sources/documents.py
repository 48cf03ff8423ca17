"""Documents kept as an append-only log (tenant_id, id, seq, created_at, data, deleted)
with latest-wins views.  A view finds the winning write of every key first, by
fixed-width order keys that are combined map-side (hash aggregates: the log isn't
sorted, a document written a billion times costs one row per map task), and then
fetches what was written by key and order.  A compacted log is a snapshot of such winners and the writes since."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcast.functions.series import join_on, settle

KEY = ("tenant_id", "id")
#: The order of the run states, for writes with equal sequence numbers.
STATUS_RANK = {"PENDING": 0, "RUNNING": 1, "DONE": 2, "FAILED": 2}


def status_rank(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    rank = F.lit(-1)
    for name, r in STATUS_RANK.items():
        rank = F.when(c == name, r).otherwise(rank)
    return rank


def put(log: DataFrame, docs: DataFrame) -> DataFrame:
    """Insert-or-replace is an append."""
    return log.unionByName(docs, allowMissingColumns=True)


def delete(log: DataFrame, keys: DataFrame) -> DataFrame:
    """A tombstone per key; a key that is not there does no harm.  ``keys`` has
    (tenant_id, id, seq, created_at)."""
    return log.unionByName(keys.withColumn("deleted", F.lit(True)), allowMissingColumns=True)


def view(log: DataFrame) -> DataFrame:
    """Latest version per key, tombstones gone; created_at is the time of the first put
    after the last delete, updated_at of the latest.  A delete beats puts of its own seq."""
    return _live(log) if "deleted" in log.columns else latest(log)


def latest(log: DataFrame) -> DataFrame:
    """``view`` for a log without tombstones."""
    rest = [c for c in log.columns if c not in (*KEY, "created_at", "deleted")]
    puts = log.select(*KEY, *rest, F.col("created_at").alias("updated_at"))
    out = winners(puts, KEY, _order(puts), {"created_at": F.min("updated_at")})
    return out.select(*KEY, *rest, "created_at", "updated_at")


def _live(log: DataFrame) -> DataFrame:
    """Puts after the last tombstone of their key, reduced to the latest.  Tombstones are
    taken out and reduced by themselves: what was never deleted isn't read for them."""
    gone = F.coalesce("deleted", F.lit(False))
    dead = settle(log.where(gone).groupBy(*KEY).agg(F.max("seq").alias("_dead")))
    puts = join_on(log.where(~gone).drop("deleted"), dead, KEY, "left", rows=dead.count())
    return latest(puts.where(F.col("_dead").isNull() | (F.col("seq") > F.col("_dead"))).drop("_dead"))


def winners(rows: DataFrame, key, order: Column, aggs: dict[str, Column] | None = None) -> DataFrame:
    """The row of each key with the largest ``order`` (a whole number), with aggregates over
    all rows of its key.  Of different rows alike in order one is taken by its hash, always
    the same.  The winners' keys are settled and counted; the fetch joins by key and order,
    so that the rows of a hot key spread, or broadcasts the keys while they are few."""
    wide = [f.name for f in rows.schema.fields if _holds_map(f.dataType)]
    plain = [c for c in rows.columns if c not in wide]
    rank = order.cast("decimal(21,0)") * F.lit(1 << 56).cast("decimal(17,0)") + F.expr(
        f"shiftrightunsigned(xxhash64({', '.join(f'`{c}`' for c in plain)}), 8)"
    ).cast("decimal(17,0)")
    ranked = rows.withColumn("_o", rank.cast("decimal(38,0)"))
    won = ranked.groupBy(*key).agg(F.max("_o").alias("_o"), *[c.alias(n) for n, c in (aggs or {}).items()])
    won = settle(won)
    out = join_on(ranked, won, [*key, "_o"], rows=won.count())
    # rows alike in everything; without maps that is a hash aggregate without buffers
    return (out.dropDuplicates([*key, "_o"]) if wide else out.distinct()).drop("_o")


def _holds_map(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _holds_map(t.elementType)
    if isinstance(t, T.StructType):
        return any(_holds_map(f.dataType) for f in t.fields)
    return isinstance(t, (T.MapType, T.VariantType))


def _order(log: DataFrame) -> Column:
    """seq, then the rank of the state, as one whole number."""
    rank = status_rank("status") if "status" in log.columns else F.lit(0)
    return F.col("seq").cast("decimal(19,0)") * 4 + (rank + 1)


# -- compaction ----------------------------------------------------------------------

def compact(log: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """The snapshot (a row per key: the latest version with ``created_at``, ``updated_at``)
    after the writes of ``log``, all of them later than what ``snapshot`` holds.

    Only the delta is aggregated; a key it doesn't write keeps its row."""
    if snapshot is None:
        return view(log)
    if "deleted" not in log.columns:
        log = log.withColumn("deleted", F.lit(False))
    new = view(log)
    touched = log.groupBy(*KEY).agg(F.max(F.coalesce("deleted", F.lit(False))).alias("_deleted"))
    touched = settle(touched)
    base = join_on(snapshot, touched, KEY, "left", rows=touched.count())
    kept = base.where(F.col("_deleted").isNull()).drop("_deleted")
    first = base.where(~F.col("_deleted")).select(*KEY, F.col("created_at").alias("_first"))
    newer = join_on(new, first, KEY, "left").withColumn("created_at", F.least("_first", "created_at")).drop("_first")
    return kept.unionByName(newer, allowMissingColumns=True)


def merge_fields(log: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Field-wise upsert: per field the last write that has it wins, old fields stay.

    One aggregate over the log; a field that a record does not carry is null there.
    """
    order = F.col("seq")
    return log.groupBy(*KEY).agg(
        *[F.max_by(c, F.when(c.isNotNull(), order)).alias(n) for n, c in fields.items()]
    )


def merge_maps(log: DataFrame, fields: str) -> DataFrame:
    """``merge_fields`` for records with a MAP of open fields."""
    long = log.select(*KEY, "seq", F.explode(fields).alias("field", "value"))
    last = long.groupBy(*KEY, "field").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy(*KEY).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias(fields)
    )


def get(view: DataFrame, keys: DataFrame) -> DataFrame:
    """Look up many keys; a missing one gives nulls."""
    return keys.join(view, list(KEY), "left")


def exists(view: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(view.select(*KEY), list(KEY), "left_semi")


def list_tenant(view: DataFrame, tenant: str = "public") -> DataFrame:
    """Documents of a tenant, newest first, ties by id."""
    return view.where(F.col("tenant_id") == tenant).orderBy(F.desc("created_at"), "id")


def keys(view: DataFrame) -> DataFrame:
    return view.select(*KEY).distinct()


def mark_updates(view: DataFrame, updates: DataFrame) -> DataFrame:
    """``outcome`` APPLIED when the key is there, else REJECTED."""
    have = view.select(*KEY).distinct().withColumn("_have", F.lit(True))
    outcome = F.when(F.col("_have"), "APPLIED").otherwise("REJECTED")
    return updates.join(have, list(KEY), "left").withColumn("outcome", outcome).drop("_have")


def update_existing(view: DataFrame, updates: DataFrame) -> DataFrame:
    """The updates whose key is there."""
    return updates.join(view.select(*KEY), list(KEY), "left_semi")


def create_new(view: DataFrame, incoming: DataFrame) -> DataFrame:
    """Creates with outcome CREATED, or CONFLICT if the key is there already or came
    earlier in the same batch (lowest seq first)."""
    first = incoming.groupBy(*KEY).agg(F.min("seq").alias("_first"))
    known = view.select(*KEY).distinct().withColumn("_known", F.lit(True))
    taken = first.join(known, list(KEY), "left")
    outcome = F.when(F.col("_known") | (F.col("seq") > F.col("_first")), "CONFLICT").otherwise("CREATED")
    return incoming.join(taken, list(KEY)).withColumn("outcome", F.coalesce(outcome, F.lit("CREATED"))).drop(
        "_first", "_known"
    )


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose parent does not exist."""
    p = parent.select(F.col(parent_key).alias("_p")).distinct()
    return child.join(p, child[child_key] == F.col("_p"), "left_anti")


def lifecycle(log: DataFrame) -> DataFrame:
    """Fold a status log to one row per key: last status, first/last times and the times
    of each state, all in one hash aggregate, then the last status by key and order."""
    def at(status: str, fn) -> Column:
        return fn(F.when(F.col("status") == status, F.col("created_at")))

    folded = {
        "updated_at": F.max("created_at"),
        "started_at": at("RUNNING", F.min),
        "completed_at": F.max(F.when(F.col("status").isin("DONE", "FAILED"), F.col("created_at"))),
        "writes": F.count(F.lit(1)),
        "_first": F.min("created_at"),
    }
    out = winners(log.select(*KEY, "seq", "status", "created_at"), KEY, _order(log), folded)
    return out.select(*KEY, "status", F.col("_first").alias("created_at"), "updated_at", "started_at", "completed_at", "writes")


def tail(log: DataFrame, n: int, key: tuple[str, ...] = KEY, order: str = "seq") -> DataFrame:
    """The last n entries per key, in ascending order of ``rn`` (1 = oldest kept).

    row_number() <= n lets Spark keep n rows per key and map task before the shuffle.
    """
    if not 1 <= n <= 1000:
        raise ValueError("tail is 1..1000")
    desc = Window.partitionBy(*key).orderBy(F.desc(order))
    kept = log.withColumn("_d", F.row_number().over(desc)).where(F.col("_d") <= n)
    asc = Window.partitionBy(*key).orderBy(order)
    return kept.withColumn("rn", F.row_number().over(asc)).drop("_d")
