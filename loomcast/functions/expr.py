"""Scalar expressions shared by the operators (built-in functions only)."""

from __future__ import annotations

import datetime as dt
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ratio(a, b) -> Column:
    """a / b, null when b is 0 (ANSI mode would raise)."""
    return F.try_divide(_c(a), _c(b))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mark(bad: Column, rule: str, path: str) -> Column:
    """A violation struct when ``bad`` is true, else null."""
    return F.when(bad, F.struct(F.lit(rule).alias("rule"), F.lit(path).alias("path")))


def violations(df: DataFrame, ids: Sequence[str], rules: Sequence[Column]) -> DataFrame:
    """One row per broken rule: (ids..., rule, path); one pass, no shuffle."""
    found = F.array_compact(F.array(*rules))
    return df.select(*ids, F.explode(found).alias("_v")).select(*ids, "_v.rule", "_v.path")


ID_DIGITS = 32


def digest_id(prefix: str, *parts) -> Column:
    """Deterministic id: the prefix and 32 hex digits of a digest of the parts, so that a
    rerun after a lost executor gives the same id.  (8 digits, as short random ids have,
    collide from some ten thousand ids on, and ids are joined on.)"""
    marked = []  # each part after its length, so that no two lists of parts, nulls among them, read alike
    for p in parts:
        s = _c(p).cast("string")
        marked.append(F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    text = F.concat(*marked)
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, ID_DIGITS))


def horizon_list(text) -> Column:
    """'7, 1,x,1,0' -> [1, 7]: whole numbers above 0, distinct, ascending; null if none."""
    nums = F.transform(F.split(_c(text), ","), lambda s: F.trim(s).try_cast("int"))
    clean = F.array_sort(F.array_distinct(F.filter(nums, lambda n: n > 0)))
    return F.when(F.size(clean) > 0, clean)


def decode_field(raw) -> Column:
    """Bytes to text, then to compact JSON if it parses, else a JSON string."""
    s = F.decode(_c(raw), "UTF-8")
    quoted = F.to_json(F.array(s))
    return F.coalesce(F.to_json(F.try_parse_json(s)), F.substr(quoted, F.lit(2), F.length(quoted) - 2))


def anchored(col, pattern: str) -> Column:
    """Full-match of a label against a pattern (both ends anchored)."""
    return _c(col).rlike(f"^(?:{pattern})$")


# -- business days ---------------------------------------------------------

def next_weekday(d) -> Column:
    """The next Monday-to-Friday date after d."""
    d = _c(d)
    skip = F.when(F.dayofweek(d) == 6, 3).when(F.dayofweek(d) == 7, 2).otherwise(1)
    return F.date_add(d, skip)


def business_calendar(
    spark: SparkSession, start: dt.date, end: dt.date, holidays: Sequence[dt.date] = (), market: str | None = None
) -> DataFrame:
    """(day, next_open[, market]) for every day of the range; an equi-join dimension.

    The longest closed run is bounded by the weekends around the holidays, so each
    day looks at a short sequence of candidates.
    """
    closed = F.array(*[F.lit(h) for h in sorted(set(holidays))]) if holidays else None
    reach = 4 + 3 * len(set(holidays))
    n = (end - start).days + 1
    df = spark.range(n).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("day"))

    def is_open(x: Column) -> Column:
        ok = ~F.dayofweek(x).isin(1, 7)
        return ok & ~F.array_contains(closed, x) if closed is not None else ok

    cand = F.filter(F.sequence(F.date_add("day", 1), F.date_add("day", reach)), is_open)
    out = df.select("day", F.get(cand, F.lit(0)).alias("next_open"))
    return out.withColumn("market", F.lit(market)) if market is not None else out


def with_next_open(df: DataFrame, day: str, calendar: DataFrame, out: str = "next_open") -> DataFrame:
    """Join the calendar (a dimension of one row per day, and per market if it has one); a day outside its span gets
    the next weekday."""
    cal = calendar.withColumnRenamed("next_open", out)
    on = df[day] == cal["day"]
    if "market" in cal.columns:
        cal = cal.withColumnRenamed("market", "_market")
        on = on & (df["market"] == cal["_market"])
    joined = df.join(cal, on, "left").withColumn(out, F.coalesce(F.col(out), next_weekday(df[day])))
    return joined.drop("day" if day != "day" else cal["day"], "_market")
