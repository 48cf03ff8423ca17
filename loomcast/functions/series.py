"""Ordered series in bounded blocks.

Almost every operator of this engine looks at a series (one symbol, one metric
stream, one run) in time order.  ``Window.partitionBy(symbol)`` alone would put a
whole series into one task, and one series may hold a third of all rows.  So a
frame is laid out once in *blocks* of consecutive rows:

* rows per (series, time slice) are counted (a map-side combined aggregate);
* slices are put together, in order, to blocks of about ``block_rows`` rows;
* a block also gets copies of the rows just before (and after) it that its windows
  look at (its halo), marked ``_own = false`` and dropped at the end;
* windows then partition by (series, block), which is one shuffle for all of the
  columns computed on the layout.

Functions with unlimited memory (running totals, last known value) are computed
per block and corrected with what the earlier blocks of the series carry over: one
row per block, so that step is small.

A series that is known, or measured, to be no longer than one block keeps the
plain ``partitionBy(series)`` plan: its block number is a literal, which the
optimizer removes from the window specification.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loomcast.session import shared_dir

#: A lookup table of at most this many rows (about 64 bytes each) is broadcast.
BROADCAST_ROWS = 500_000

DAY = 86_400


@dataclass(frozen=True)
class Axis:
    """How the rows of a frame form ordered series.

    ``max_rows`` is a proven upper bound of the rows of one series, None if there is
    none (then it is measured).  ``slice_seconds`` is the width of the counted time
    slices, None to derive it from the longest series.
    """

    key: tuple[str, ...] = ("symbol",)
    order: str = "ts"
    tie: tuple[str, ...] = ()
    block_rows: int = 1 << 20
    max_rows: int | None = None
    slice_seconds: float | None = None

    def but(self, **changes) -> "Axis":
        return replace(self, **changes)


#: Bars that were grouped by (symbol, calendar day): a century is 36,600 rows.
DAILY = Axis(max_rows=100 * 366)
#: Bars that were grouped by (symbol, hour).
HOURLY = Axis(max_rows=100 * 366 * 24)


def longest_series(df: DataFrame, key: tuple[str, ...]) -> int:
    """Rows of the longest series: one partial aggregate, one number to the driver."""
    row = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()
    return int(row[0] or 0)


def epoch_micros(col: Column, dtype: str) -> Column:
    """A time (or a plain number, taken as seconds) as whole microseconds."""
    if dtype == "date":
        return F.unix_date(col).cast("long") * (DAY * 1_000_000)
    if dtype in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(col.cast("timestamp"))
    return F.floor(col.cast("double") * 1e6)


def epoch_seconds(col: Column, dtype: str) -> Column:
    return F.floor(epoch_micros(col, dtype) / 1_000_000)


def join_on(left: DataFrame, right: DataFrame, cols, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Null-safe join on ``cols``.  A right side counted to be small is broadcast;
    otherwise the choice is left to the optimizer."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in cols], *[c for c in right.columns if c not in cols])
    if rows is not None and rows <= BROADCAST_ROWS:
        r = F.broadcast(r)
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in cols])


def settle(df: DataFrame) -> DataFrame:
    """Write a small result (a row per series or run) to the checkpoint folder, so that
    the steps after it read it instead of computing it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def join_stats(df: DataFrame, stats: DataFrame, key) -> DataFrame:
    """Bring one row of statistics per group back to the rows.

    The statistics are settled and counted first: while they are small they are
    broadcast, so the rows (and a hot group) are not shuffled at all.
    """
    stats = settle(stats)
    return join_on(df, stats, key, rows=stats.count())


def at_last(cols, *order: str) -> list[Column]:
    """Columns of the last row of a group, as aggregates.

    One aggregate per column with a plain order column: Spark hash-aggregates
    fixed-width columns, a struct of them would be sorted.
    """
    by = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return [F.max_by(c, by).alias(c) for c in cols]


class Blocks:
    """A laid out frame; immutable, every method gives a new one."""

    def __init__(self, df: DataFrame, axis: Axis, split: bool, halo: bool, indexes: tuple["EmaIndex", ...] = ()):
        self.df, self.axis, self.split, self.halo, self.indexes = df, axis, split, halo, indexes

    # -- windows -----------------------------------------------------------
    @property
    def part(self) -> list[str]:
        return [*self.axis.key, "_blk"]

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(self.axis.order, *self.axis.tie)

    def frame(self, n: int) -> WindowSpec:
        """The last n rows, this one included."""
        return self.w.rowsBetween(-(n - 1), 0)

    def roll(self, fn, col: str, n: int) -> Column:
        """fn over the last n rows; null until there are n non-null values."""
        return F.when(F.count(col).over(self.frame(n)) >= n, fn(F.col(col)).over(self.frame(n)))

    def lag(self, col, k: int = 1) -> Column:
        return F.lag(col, k).over(self.w)

    def lead(self, col, k: int = 1) -> Column:
        return F.lead(col, k).over(self.w)

    # -- columns -----------------------------------------------------------
    def _with(self, df: DataFrame) -> "Blocks":
        return Blocks(df, self.axis, self.split, self.halo, self.indexes)

    def add(self, cols: dict[str, Column]) -> "Blocks":
        return self._with(self.df.withColumns(cols))

    def drop(self, *cols: str) -> "Blocks":
        return self._with(self.df.drop(*cols))

    def own(self) -> "Blocks":
        """Drop the halo rows; needed before totals are carried between blocks."""
        if not self.halo:
            return self
        return Blocks(self.df.where("_own").drop("_own"), self.axis, self.split, False, self.indexes)

    def rows(self) -> DataFrame:
        return self.own().df.drop("_blk", *[c for i in self.indexes for c in (i.pos, i.leaf)])

    # -- unlimited memory --------------------------------------------------
    def running_sum(self, cols: dict[str, Column], within: tuple[str, ...] = ()) -> "Blocks":
        """Running totals from the start of the series (or of each ``within`` group)."""
        b = self.own()
        steps = {f"_s_{n}": F.coalesce(c, F.lit(0)) for n, c in cols.items()}
        df = b.df.withColumns(steps)
        run = (
            Window.partitionBy(*b.part, *within)
            .orderBy(b.axis.order, *b.axis.tie)
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        local = df.withColumns({n: F.sum(f"_s_{n}").over(run) for n in cols})
        if not b.split:
            return b._with(local.drop(*steps))
        tails = df.groupBy(*b.part, *within).agg(*[F.sum(s).alias(s) for s in steps])
        before = (
            Window.partitionBy(*b.axis.key, *within).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = tails.select(
            *b.part, *within, *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in cols]
        )
        out = _join_carry(local.drop(*steps), carry, [*b.part, *within])
        out = out.withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in cols})
        return b._with(out.drop(*[f"_c_{n}" for n in cols]))

    def last_known(self, cols: dict[str, Column]) -> "Blocks":
        """The last non-null value so far, from the start of the series."""
        b = self.own()
        steps = {f"_s_{n}": c for n, c in cols.items()}
        df = b.df.withColumns(steps)
        run = b.w.rowsBetween(Window.unboundedPreceding, 0)
        local = df.withColumns({n: F.last(f"_s_{n}", True).over(run) for n in cols})
        if not b.split:
            return b._with(local.drop(*steps))
        key = F.struct(b.axis.order, *b.axis.tie) if b.axis.tie else F.col(b.axis.order)
        tails = df.groupBy(*b.part).agg(
            *[F.max_by(F.col(s), F.when(F.col(s).isNotNull(), key)).alias(s) for s in steps]
        )
        before = Window.partitionBy(*b.axis.key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        carry = tails.select(*b.part, *[F.last(f"_s_{n}", True).over(before).alias(f"_c_{n}") for n in cols])
        out = _join_carry(local.drop(*steps), carry, b.part)
        out = out.withColumns({n: F.coalesce(n, f"_c_{n}") for n in cols})
        return b._with(out.drop(*[f"_c_{n}" for n in cols]))

    def number(self, name: str = "rn") -> "Blocks":
        """Row number in the whole series, from 1."""
        return self.running_sum({name: F.lit(1).cast("long")})

    # -- linear recurrence -------------------------------------------------
    def ema(self, cols: dict[str, tuple[str, float]], like: str | None = None) -> "Blocks":
        """e = (1-a)·e_prev + a·x, seeded with the first value; nulls are skipped.

        Written as a prefix sum: within a leaf of L rows, e_j = q^j·Σ a·x_i·q^-i plus
        q^(j+1) times the state before the leaf, q = 1-a.  L keeps q^-L far from overflow
        and makes the weight q^L of older leaves vanish next to double precision, so that
        state is just the last leaf's own sum.  All windows, no Python.
        A block is one affine map of the state before it (factor, sum); the maps of a
        series' blocks are composed in order, so blocks of any size and values however
        sparse give the same averages.  Halo rows count for nothing here and hold no
        average.  ``like`` names a column that is null in the same rows; EMAs alike share
        their leaves, and so one sort.
        """
        b = self
        leaves: dict[EmaIndex, dict[str, tuple[str, float]]] = {}
        for n, (x, a) in cols.items():
            if a >= 1.0:
                b = b.add({n: F.col(x)})
            else:
                b, index = b.ema_index(like or x, a)
                leaves.setdefault(index, {})[n] = (x, a)
        for index, live in leaves.items():
            b = b._ema_in_leaves(index, live)
        return b

    def _mine(self, col: str, like: str | None = None) -> Column:
        """The values that a recurrence takes in: of the block's own rows, where ``like`` is known."""
        known = F.col(like or col).isNotNull()
        return F.when(F.col("_own") & known if self.halo else known, F.col(col))

    def _ema_in_leaves(self, index: "EmaIndex", live: dict[str, tuple[str, float]]) -> "Blocks":
        b, leaf = self, index.leaf
        at = F.col(index.pos) - F.col(leaf) * index.rows
        inner = (
            Window.partitionBy(*b.part, leaf)
            .orderBy(b.axis.order, *b.axis.tie)
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        chain = Window.partitionBy(*b.part).orderBy(leaf, b.axis.order, *b.axis.tie)
        z, tail, alone, out = {}, {}, {}, {}
        for n, (x, a) in live.items():
            lq = math.log1p(-a)
            z[f"_z_{n}"] = F.exp(at * F.lit(lq)) * F.sum(b._mine(x, index.col) * F.lit(a) * F.exp(at * F.lit(-lq))).over(inner)
            tail[f"_t_{n}"] = F.last(F.when(at == index.rows - 1, F.col(f"_z_{n}")), True).over(
                chain.rowsBetween(Window.unboundedPreceding, -1)
            )
            tail[f"_f_{n}"] = F.first(b._mine(x, index.col), True).over(chain.rowsBetween(Window.unboundedPreceding, 0))
            weight = F.exp((at + 1) * F.lit(lq))
            alone[f"_a_{n}"] = F.col(f"_z_{n}") + F.when(F.col(leaf) > 0, weight * F.col(f"_t_{n}")).otherwise(0.0)
            state = F.coalesce(f"_c_{n}", f"_f_{n}") if b.split else F.col(f"_f_{n}")
            e = F.col(f"_a_{n}") + F.when(F.col(leaf) > 0, 0.0).otherwise(weight * state)
            out[n] = F.when(F.col(index.pos) < 0, F.col(f"_c_{n}")).otherwise(e) if b.split else e
        b = b.add(z).add(tail).add(alone)
        if b.split:
            b = b._with(b.df.join(b._ema_before(index, live), b.part))
        return b.add(out).drop(*z, *tail, *alone, *([f"_c_{n}" for n in live] if b.split else []))

    def _ema_before(self, index: "EmaIndex", live: dict[str, tuple[str, float]]) -> DataFrame:
        """For each block, the averages before it (``_c_<name>``; null if the series has no value there yet).

        One row per block: its values' count, first value and average without a past.  They are settled, and
        composed by doubling: after step k a map covers the 2^k blocks up to its own.
        """
        known, pos = self.own().df, F.col(index.pos)
        maps = known.groupBy(*self.part).agg(
            (F.max(index.pos) + 1).alias("_n"),
            *[F.max_by(f"_a_{n}", F.when(pos >= 0, pos)).alias(f"_s_{n}") for n in live],
            *[F.min_by(x, F.when(F.col(index.col).isNotNull(), pos)).alias(f"_f_{n}") for n, (x, _) in live.items()],
        )
        maps = settle(maps)
        blocks, last = maps.agg(F.count(F.lit(1)), F.max("_blk")).first()
        order = Window.partitionBy(*self.axis.key).orderBy("_blk")
        every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        scan = maps.withColumns({"_seen": F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))}).withColumns(
            {
                **{f"_q_{n}": F.exp(F.col("_n") * F.lit(math.log1p(-a))) for n, (_, a) in live.items()},
                **{f"_s_{n}": F.coalesce(f"_s_{n}", F.lit(0.0)) for n in live},
                **{f"_f_{n}": F.first(f"_f_{n}", True).over(every) for n in live},
            }
        )
        reach = 1
        while reach <= (last or 0):
            older = {f"_o{c}_{n}": F.lag(f"_{c}_{n}", reach).over(order) for n in live for c in "qs"}
            scan = scan.withColumns(older).withColumns(
                {
                    **{f"_s_{n}": F.col(f"_s_{n}") + F.col(f"_q_{n}") * F.coalesce(f"_os_{n}", F.lit(0.0)) for n in live},
                    **{f"_q_{n}": F.col(f"_q_{n}") * F.coalesce(f"_oq_{n}", F.lit(1.0)) for n in live},
                }
            ).drop(*older)
            reach *= 2
        state = {f"_e_{n}": F.col(f"_s_{n}") + F.col(f"_q_{n}") * F.col(f"_f_{n}") for n in live}
        before = scan.withColumns(state).select(
            *self.part, *[F.when(F.col("_seen") > 0, F.lag(f"_e_{n}").over(order)).alias(f"_c_{n}") for n in live]
        )
        return F.broadcast(before) if blocks <= BROADCAST_ROWS else before

    def ema_index(self, col: str, alpha: float) -> tuple["Blocks", "EmaIndex"]:
        """Positions and leaves for EMAs of rows where ``col`` is not null; leaves made
        before are used again if they suit this factor."""
        if not 0.0 < alpha < 1.0:
            raise ValueError("a smoothing factor is above 0 and below 1 here")
        rate = -math.log1p(-alpha)
        for index in self.indexes:
            if index.col == col and 60.0 <= index.rows * rate <= 600.0:
                return self, index
        rows = max(1, int(200.0 / rate))
        k = len(self.indexes)
        index = EmaIndex(col, f"_pos{k}", f"_leaf{k}", rows)
        run = self.w.rowsBetween(Window.unboundedPreceding, 0)
        b = self.add({index.pos: F.count(self._mine(col)).over(run) - 1})
        b = b.add({index.leaf: F.floor(F.col(index.pos) / rows)})
        return Blocks(b.df, b.axis, b.split, b.halo, (*b.indexes, index)), index


@dataclass(frozen=True)
class EmaIndex:
    col: str
    pos: str
    leaf: str
    rows: int


def _join_carry(rows: DataFrame, carry: DataFrame, on: list[str]) -> DataFrame:
    """Bring one row per block back to the rows: settled and counted, then broadcast; else
    joined on the blocks' own partitioning.  Either way the rows are not shuffled again."""
    carry = settle(carry)
    return rows.join(F.broadcast(carry) if carry.count() <= BROADCAST_ROWS else carry, on)


def _one_block(df: DataFrame, axis: Axis) -> Blocks:
    return Blocks(df.withColumn("_blk", F.lit(0).cast("long")), axis, split=False, halo=False)


def _longest_and_span(df: DataFrame, axis: Axis, at: Column) -> tuple[int, int]:
    """Rows of the longest series, and the microseconds it spans."""
    per = df.groupBy(*axis.key).agg(F.count(F.lit(1)).alias("n"), (F.max(at) - F.min(at) + 1).alias("span"))
    row = per.agg(F.max(F.struct("n", "span"))).first()[0]
    return (int(row["n"]), int(row["span"])) if row else (0, 1)


def lay_out(df: DataFrame, axis: Axis, lookback: int = 0, lookahead: int = 0) -> Blocks:
    """Lay a frame out in blocks whose windows may look ``lookback`` rows back and
    ``lookahead`` rows ahead.  Rows without a key or time belong to no series and are
    left out (the series check reports them)."""
    df = df.dropna("any", subset=[*axis.key, axis.order])
    if axis.max_rows is not None and axis.max_rows <= axis.block_rows:
        return _one_block(df, axis)
    at = epoch_micros(F.col(axis.order), dict(df.dtypes)[axis.order])
    longest, span = _longest_and_span(df, axis, at)
    if longest <= axis.block_rows:
        return _one_block(df, axis)

    shared_dir(df.sparkSession)
    size = max(axis.block_rows, lookback, 1)
    width = int(axis.slice_seconds * 1e6) if axis.slice_seconds else max(1, span * size // (4 * longest))
    while True:
        rows = df.withColumn("_slice", F.floor(at / width))
        counts = rows.groupBy(*axis.key, "_slice").agg(F.count(F.lit(1)).alias("_n")).checkpoint()
        n_slices, fullest = counts.agg(F.count(F.lit(1)), F.max("_n")).first()
        if fullest <= size or width == 1:
            break
        # rows crowd in a part of the time span: count again in narrower slices, down to single times
        width = max(1, width * size // (4 * fullest))

    by_slice = Window.partitionBy(*axis.key).orderBy("_slice")
    plan = counts.withColumn(
        "_before", F.coalesce(F.sum("_n").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("_home", F.floor(F.col("_before") / size))
    targets = [F.array("_home")]
    if lookback:
        after = F.col("_before") + F.col("_n")
        targets.append(F.sequence(F.floor(after / size), F.floor((after + (lookback - 1)) / size)))
    if lookahead:
        near = Window.partitionBy(*axis.key).orderBy("_before")
        plan = plan.withColumn("_ahead", F.collect_set("_home").over(near.rangeBetween(-lookahead, -1))).withColumn(
            "_reach", F.max("_home").over(near.rangeBetween(Window.unboundedPreceding, -lookahead))
        )
        targets += [F.col("_ahead"), F.array_compact(F.array("_reach"))]
    plan = plan.select(*axis.key, "_slice", "_home", F.array_distinct(F.concat(*targets)).alias("_targets"))

    laid = rows.join(F.broadcast(plan) if n_slices <= BROADCAST_ROWS else plan, [*axis.key, "_slice"])
    laid = laid.withColumn("_blk", F.explode("_targets")).withColumn("_own", F.col("_blk") == F.col("_home"))
    return Blocks(laid.drop("_slice", "_home", "_targets"), axis, split=True, halo=True)
