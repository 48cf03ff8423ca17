"""Plan configuration as data: names, defaults, legacy fields, parameter merging."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.functions.expr import horizon_list

# Market names and their tickers.
US_MARKETS = {
    "S&P 500": "^GSPC",
    "Dow Jones Industrial Average": "^DJI",
    "NASDAQ Composite": "^IXIC",
    "Russell 2000": "^RUT",
    "VIX (S&P 500)": "^VIX",
    "VXN (Nasdaq Volatility)": "^VXN",
    "US 10Y Treasury Yield": "^TNX",
    "US 2Y Treasury Yield": "^FVX",
    "USD Index": "DX-Y.NYB",
    "EUR/USD": "EURUSD=X",
    "USD/JPY": "JPY=X",
    "Brent Crude": "BZ=F",
    "WTI Crude": "CL=F",
    "Natural Gas": "NG=F",
    "Gold": "GC=F",
    "Silver": "SI=F",
    "Copper": "HG=F",
    "Corn": "ZC=F",
    "Wheat": "ZW=F",
    "Soybeans": "ZS=F",
    "Bitcoin (USD)": "BTC-USD",
    "Ethereum (USD)": "ETH-USD",
    "SPDR S&P 500 ETF Trust": "SPY",
    "Invesco QQQ Trust": "QQQ",
    "iShares Russell 2000 ETF": "IWM",
    "iShares MSCI EAFE ETF": "EFA",
    "iShares MSCI Emerging Markets ETF": "EEM",
    "SOXX (Semiconductor ETF)": "SOXX",
    "XLE (Energy ETF)": "XLE",
    "XLP (Consumer Staples ETF)": "XLP",
    "US Oil Fund": "USO",
    "US Natural Gas Fund": "UNG",
    "iShares 20+ Year Treasury Bond ETF": "TLT",
    "iShares High Yield Corporate Bond ETF": "HYG",
    "iShares Investment Grade Corporate Bond ETF": "LQD",
    "iShares TIPS Bond ETF": "TIP",
    "Vanguard Total Bond Market ETF": "BND",
    "iShares Core U.S. Aggregate Bond ETF": "AGG",
}
JP_MARKETS = {
    "Nikkei 225": "^N225",
    "TOPIX": "^TOPX",
    "JPX-Nikkei 400": "^JPXNK400",
    "日経 VI": "^VNKY",
    "JGB 10Y": "JP10Y-JP",
    "USD/JPY": "JPY=X",
    "S&P 500": "^GSPC",
    "Dow Jones Industrial Average": "^DJI",
    "NASDAQ Composite": "^IXIC",
    "FTSE 100": "^FTSE",
    "DAX": "^GDAXI",
    "Gold": "GC=F",
    "Crude Oil": "CL=F",
    "Copper": "HG=F",
    "Rubber Futures (TOCOM)": "0#JRU:",
    "Gold Futures (Osaka)": "0#JNKG:",
    "半導体株 ETF (1618.T)": "1618.T",
    "TOPIX 銀行 ETF (1615.T)": "1615.T",
    "iShares MSCI Japan ETF": "EWJ",
    "iShares China Large-Cap ETF": "FXI",
}


def ticker_map(spark: SparkSession, *maps: Mapping[str, str]) -> DataFrame:
    """(name, ticker); a later map wins."""
    merged = {k: v for m in (maps or (US_MARKETS, JP_MARKETS)) for k, v in m.items()}
    return spark.createDataFrame(sorted(merged.items()), "name string, ticker string")


def resolve_universe(
    plans: DataFrame, tickers: DataFrame | Mapping[str, str], key: str = "plan_id", universe: str = "universe"
) -> DataFrame:
    """Market names to tickers in place; unknown names stay, the order is kept.

    A map out of the configuration becomes a literal: no shuffle.  A table is joined
    name by name (Spark broadcasts it while it is below its size limit) and the names
    of a plan, a handful, are put together again.
    """
    if isinstance(tickers, Mapping):
        lookup = F.create_map(*[F.lit(x) for kv in tickers.items() for x in kv])
        return plans.withColumn(universe, F.transform(universe, lambda n: F.coalesce(F.try_element_at(lookup, n), n)))
    rest = [c for c in plans.columns if c not in (key, universe)]
    rows = plans.withColumn("_row", F.monotonically_increasing_id())  # plans that share an id stay apart
    names = rows.select("_row", key, *rest, F.posexplode_outer(universe).alias("_pos", "_name"))
    t = tickers.select(F.col("name").alias("_tn"), "ticker")
    hit = names.join(t, F.col("_name") == F.col("_tn"), "left")
    item = F.struct(F.col("_pos").alias("p"), F.coalesce("ticker", "_name").alias("v"))
    back = hit.groupBy("_row").agg(
        *[F.any_value(c).alias(c) for c in (key, *rest)],
        F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), item))).alias("_u"),
    )
    return back.select(key, *rest, F.transform("_u", lambda s: s["v"]).alias(universe))


def ancestors(path: str) -> list[str]:
    parts = path.split(".")
    return [".".join(parts[:i]) for i in range(1, len(parts))]


def overlay_defaults(leaves: DataFrame, defaults: Mapping[str, str], key: str = "plan_id") -> DataFrame:
    """Recursive overlay on leaf rows (key, path, value): a plan's leaf replaces the
    default of the same path, all defaults below it, and a default that sits where the
    plan has a subtree; lists are one leaf and are replaced whole.

    Per plan only the set of its own paths and of their ancestors is aggregated, and each
    default looks itself up in it; nothing is compared pairwise.
    """
    up = F.slice(F.split("path", r"\."), F.lit(1), F.size(F.split("path", r"\.")) - 1)
    levels = F.transform(F.sequence(F.lit(1), F.size(up)), lambda n: F.array_join(F.slice(up, F.lit(1), n), "."))
    parents = F.when(F.size(up) > 0, levels).otherwise(F.array().cast("array<string>"))
    per_plan = leaves.groupBy(key).agg(
        F.collect_set("path").alias("_own"),
        F.array_distinct(F.flatten(F.collect_set(parents))).alias("_inner"),
    )
    entries = F.array(*[
        F.struct(
            F.lit(p).alias("path"), F.lit(str(v)).alias("value"),
            F.array(*[F.lit(a) for a in [p, *ancestors(p)]]).alias("up"),
        ) for p, v in sorted(defaults.items())
    ])
    # the plan's paths meet the defaults inside its own row; only the defaults it lacks become rows
    lacking = F.filter(entries, lambda d: ~F.arrays_overlap(d["up"], F.col("_own")) & ~F.array_contains("_inner", d["path"]))
    added = per_plan.select(key, F.explode(lacking).alias("_d"))
    return leaves.select(key, "path", "value").unionByName(added.select(key, "_d.path", "_d.value"))


def flatten_leaves(tree: Mapping, prefix: str = "") -> dict[str, str]:
    """A configuration tree of one document as {path: value}; lists stay one leaf."""
    out: dict[str, str] = {}
    for k, v in tree.items():
        path = f"{prefix}.{k}" if prefix else str(k)
        if isinstance(v, Mapping) and v:
            out.update(flatten_leaves(v, path))
        else:
            out[path] = str(v)
    return out


def legacy_fields(plans: DataFrame) -> DataFrame:
    """symbol = first of the universe, start/end = training dates, only where not given."""
    return plans.withColumns({
        "symbol": F.coalesce("symbol", F.get("universe", F.lit(0)), F.lit("")),
        "start": F.coalesce("start", "train_start"),
        "end": F.coalesce("end", "train_end"),
    })


def merge_params(requests: DataFrame, plans: DataFrame, key: str = "plan_id") -> DataFrame:
    """Request over plan; ``reason`` is null for accepted rows.

    Indicators fall back to the plan's and then to SMA(5), the run number to 1.
    """
    p = plans.select(key, *[F.col(c).alias(f"_{c}") for c in ("symbol", "start", "end", "universe", "indicators")],
                     F.lit(True).alias("_known"))
    j = requests.join(p, key, "left")
    symbol = F.coalesce(F.nullif("symbol", F.lit("")), F.nullif("_symbol", F.lit("")), F.get("_universe", F.lit(0)))
    merged = j.select(
        *[c for c in requests.columns if c not in ("symbol", "start", "end", "indicators", "run_no", "seq")],
        symbol.alias("symbol"),
        F.coalesce("start", "_start").alias("start"), F.coalesce("end", "_end").alias("end"),
        F.coalesce("indicators", "_indicators", F.array(F.lit("SMA:5"))).alias("indicators"),
        F.coalesce("run_no", "seq", F.lit(1)).alias("run_no"), "_known",
    )
    reason = (
        F.when(F.col("_known").isNull(), "plan not found")
        .when(F.col("start").isNull() | F.col("end").isNull(), "start/end missing")
        .when(F.coalesce("symbol", F.lit("")) == "", "symbol missing")
    )
    return merged.withColumn("reason", reason).drop("_known")


def flatten_metrics(result: Mapping[str, Column], metrics: Mapping[str, Column]) -> dict[str, Column]:
    """Nested metric fields over the parent's, per field."""
    return {k: F.coalesce(metrics[k], result[k]) if k in metrics else result[k] for k in result} | {
        k: v for k, v in metrics.items() if k not in result
    }


def flatten_metric_maps(df: DataFrame, result: str, metrics: str, out: str) -> DataFrame:
    """The same for open maps: entries of ``metrics`` win over those of ``result``."""
    kept = F.map_filter(result, lambda k, v: ~F.coalesce(F.map_contains_key(metrics, k), F.lit(False)))
    return df.withColumn(out, F.coalesce(F.map_concat(kept, metrics), F.col(result)))


def missing_keys(fields: str, required: Sequence[str]) -> Column:
    """Required keys a map does not have."""
    return F.array_except(F.array(*[F.lit(r) for r in required]), F.map_keys(fields))


def with_horizons(df: DataFrame, col: str = "horizons", out: str = "clean") -> DataFrame:
    """Parsed horizon lists; ``reason`` says why a row has none."""
    clean = horizon_list(col)
    return df.withColumn(out, clean).withColumn("reason", F.when(clean.isNull(), "no horizon above 0"))


def select_by_prefix(df: DataFrame, keep: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    return df.select(*keep, *[c for c in df.columns if c.startswith(tuple(prefixes)) and c not in keep])
