"""Fees by venue, market and tier, and the tiers of symbols, from configuration documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import Fees

#: What a tier may call its figures, fixed values.
NAMES = {"maker": ("maker_bps", "maker"), "taker": ("taker_bps", "taker"), "half_spread": ("half_spread_bps", "half_spread"), "impact": ("impact_perc_coeff", "impact")}


def tier_of(symbol: str | None, tier: str | None = None, strategy: dict | None = None) -> str:
    """The tier asked for, else the symbol's own, else the strategy's default, else vip0."""
    strategy = strategy or {}
    own = {str(k): str(v) for k, v in (strategy.get("overrides") or {}).items()}
    return tier or own.get(symbol or "") or str(strategy.get("default_tier", "vip0"))


def fees_of(document: dict, venue: str, market: str, tier: str) -> Fees:
    """The tier's fees; venues may stand at the document's top or under venues."""
    figures = document.get("venues", document).get(venue, {}).get(market, {}).get(tier, {})
    if not figures:
        raise KeyError(f"no fees for {venue}/{market}/{tier}")
    return Fees(**{name: float(next((figures[k] for k in keys if k in figures), 0)) for name, keys in NAMES.items()})


def resolved(document: dict, venue: str, market: str, symbol: str | None = None, tier: str | None = None, strategy: dict | None = None) -> tuple[Fees, str]:
    """(fees, tier)."""
    final = tier_of(symbol, tier, strategy)
    return fees_of(document, venue, market, final), final


def with_fees(rows: DataFrame, document: dict, venue: str, market: str, strategy: dict | None = None, key: str = "symbol") -> DataFrame:
    """rows with tier, maker, taker, half_spread and impact of their symbol: a broadcast join of as many rows as the configuration names."""
    overrides = (strategy or {}).get("overrides") or {}
    tiers = [(str(s), str(t)) for s, t in overrides.items()]
    default = tier_of(None, None, strategy)
    figures = [(t, *(float(x) for x in (f.maker, f.taker, f.half_spread, f.impact))) for t in sorted({default, *(t for _, t in tiers)}) for f in [fees_of(document, venue, market, t)]]
    spark = rows.sparkSession
    own = spark.createDataFrame(tiers, f"`{key}` string, __tier string")
    table = spark.createDataFrame(figures, "tier string, fee_maker double, fee_taker double, fee_half_spread double, fee_impact double")
    out = rows.join(F.broadcast(own), key, "left").withColumn("tier", F.coalesce("__tier", F.lit(default))).drop("__tier")
    return out.join(F.broadcast(table), "tier")
