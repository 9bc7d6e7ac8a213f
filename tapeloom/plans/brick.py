"""Brick scan: bars -> indicators -> signals -> labelled trades -> scores -> picks -> net value.

Shuffles: one by ``code`` for every per-instrument column, one by session for the ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import brick, indicators, outcomes, scoring


def rows(bars: DataFrame) -> DataFrame:
    """Every bar with indicators, brick columns, features and limit flags."""
    out = indicators.momentum_columns(indicators.add_indicators(bars))
    out = indicators.brick_signal(out)
    return brick.limit_flags(brick.signal_features(out))


def trades(bars: DataFrame) -> DataFrame:
    """Labelled signals."""
    return outcomes.label_trades(rows(bars))


def closed_trades(bars: DataFrame) -> DataFrame:
    return trades(bars).filter(F.col("status") == "closed")


def scored(bars: DataFrame) -> DataFrame:
    return scoring.dimension_score(trades(bars).filter(F.col("status") != "blocked"))


def top_picks(bars: DataFrame, n: int = 3) -> DataFrame:
    return scoring.pick(scored(bars), n)


def market_series(bars: DataFrame) -> DataFrame:
    """(date, active_cap): traded amount of the whole market."""
    return bars.groupBy("date").agg(F.sum("amount").alias("active_cap"))
