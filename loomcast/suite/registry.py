"""Registered queries: a Spark function over a table folder and its SQL twin."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, keep: Sequence[str], rnd: Mapping[str, int] | None = None, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``.  ``keep`` are the exact columns, ``rnd`` the
    floating ones with the decimals both sides are compared at (adding 0 turns -0 to 0)."""
    rnd = dict(rnd or {})

    def wrap(fn):
        from loomcast.suite.views import Tables

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Tables(spark, sf_dir))
            return df.select(
                *keep, *[(F.round(F.col(c).cast("double"), d) + F.lit(0.0)).alias(c) for c, d in rnd.items()]
            )

        text = None
        if sql is not None:
            cols = [*keep, *[f"round(CAST({c} AS DOUBLE), {d}) + 0.0 AS {c}" for c, d in rnd.items()]]
            text = f"SELECT {', '.join(cols)} FROM (\n{sql.strip()}\n) q"
        if name in REGISTRY:
            raise ValueError(f"query '{name}' registered twice")
        REGISTRY[name] = Query(name, run, text)
        return fn

    return wrap
