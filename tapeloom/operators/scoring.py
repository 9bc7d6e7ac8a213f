"""Cross-section scores of signals: dimension and z scores, overlays, picks and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import windows as w
from tapeloom.functions.ranks import AVERAGE_SHARE, ROWS_PER_PARTITION, partitions, pct_rank_avg, top_n, value_ranks
from tapeloom.operators.brick import FEATURES
from tapeloom.session import cut_lineage

# Weights of the features inside each dimension, and of the dimensions.
DIMENSION_FEATURES = {
    "brick": {
        "red_height": 0.322, "brick_slope_3d": 0.247, "brick_slope_5d": 0.137, "brick_value": 0.115, "red_green_ratio": 0.179,
    },
    "position": {"rsi_6": 0.281, "rsi_14": 0.220, "bb_pct_b": 0.203, "wr_14": 0.189, "close_to_yellow_pct": 0.107},
    "trend": {
        "close_to_ma5_pct": 0.172, "close_to_ma10_pct": 0.130, "close_to_ma20_pct": 0.095, "close_to_ma60_pct": 0.059,
        "close_to_white_pct": 0.105, "ret_5d": 0.117, "ret_10d": 0.075, "bullish_ratio_5d": 0.108,
        "bullish_ratio_10d": 0.075, "new_high_20d": 0.063,
    },
    "volume": {
        "obv_trend_up": 0.291, "vol_ratio_5": 0.213, "macd_hist_rising": 0.191, "turnover_ratio_5": 0.158, "vol_ratio_20": 0.147,
    },
}
DIMENSIONS = {"brick": 0.275, "position": 0.284, "trend": 0.244, "volume": 0.198}
# Spread-based weights of the z score.
Z_WEIGHTS = {
    "close_to_ma5_pct": 0.073, "red_height": 0.067, "rsi_6": 0.066, "red_green_ratio": 0.064, "close_to_ma10_pct": 0.056,
    "rsi_14": 0.054, "ret_5d": 0.053, "wr_14": 0.053, "bb_pct_b": 0.052, "brick_slope_3d": 0.050,
    "close_to_white_pct": 0.046, "close_to_ma20_pct": 0.041, "close_to_yellow_pct": 0.038, "ret_10d": 0.034,
    "vol_ratio_5": 0.034, "bullish_ratio_5d": 0.032, "close_to_ma60_pct": 0.030, "turnover_ratio_5": 0.030,
    "brick_slope_5d": 0.028, "vol_ratio_20": 0.023, "brick_value": 0.021, "bullish_ratio_10d": 0.020,
    "macd_hist_rising": 0.018, "obv_trend_up": 0.015, "new_high_20d": 0.010,
}


def dimension_score(df: DataFrame, by: str = "entry_date", keys=("code", "signal_date")) -> DataFrame:
    """Daily percentile ranks folded into four weighted dimensions and one score in 0..1.

    The rows are stored first, as they are read three times, and counted: partitions grow with them.
    """
    df = cut_lineage(df)
    rows = df.count()
    n = partitions(df, rows, ROWS_PER_PARTITION)
    ranks = value_ranks(df, {f: f for f in FEATURES}, [*keys, by], by, rows)
    long = ranks.selectExpr(*keys, by, "feature", f"coalesce({AVERAGE_SHARE}, 0.5D) AS rank").repartition(n, *keys, by)
    ranked = long.groupBy(*keys, by).agg(*[F.expr(f"max(CASE WHEN feature = '{f}' THEN rank END)").alias(f"_r_{f}") for f in FEATURES])
    # Terms are added in one order for every row, so rows of equal ranks have equal scores to the last bit.
    dims = {d: "(" + " + ".join(f"_r_{f} * {wt}D" for f, wt in ws.items()) + f") / {sum(ws.values())!r}D" for d, ws in DIMENSION_FEATURES.items()}
    wide = df.repartition(n, *keys, by).join(ranked.selectExpr(*keys, by, *[f"{e} AS dim_{d}" for d, e in dims.items()]), [*keys, by])
    score = " + ".join(f"dim_{d} * {wt}D" for d, wt in DIMENSIONS.items())
    return wide.selectExpr(*df.columns, *[f"dim_{d}" for d in dims], f"{score} AS score")


def rolling_z_score(
    df: DataFrame, by: str = "entry_date", sessions: int = 60, least: int = 10, keys=("code", "signal_date")
) -> DataFrame:
    """Weighted z scores against the pooled rows of the previous ``sessions`` sessions.

    Each session is first reduced to count, sum and sum of squares per feature, combined on the map side; the window then runs over one
    row per session and feature. Its result, one row per session, is sent to the rows, which never travel. They are stored, as they are read twice.
    """
    df = cut_lineage(df)
    sums = df.groupBy(by).agg(*[
        F.expr(f"struct(count({v}) AS n, sum({v}) AS s, sum({v} * {v}) AS q)").alias(f) for f in FEATURES for v in [f"CAST({f} AS DOUBLE)"]
    ])
    per_day = sums.selectExpr(by, "inline(array(" + ", ".join(f"struct('{f}' AS feature, {f}.n AS n, {f}.s AS s, {f}.q AS q)" for f in FEATURES) + "))")
    past = w.rows(sessions, 1, "feature", by)
    stats = per_day.selectExpr(
        by, "feature", f"count(1) {past} AS days", f"sum(n) {past} AS n", f"sum(s) {past} AS s", f"sum(q) {past} AS q"
    ).filter(f"days >= {least} AND n >= {least}")
    stats = stats.selectExpr(by, "feature", "struct(s / n AS mu, sqrt(greatest((q - s * s / n) / (n - 1), 0D)) AS sd) AS m")
    wide = stats.groupBy(by).agg(*[F.expr(f"max(CASE WHEN feature = '{f}' THEN m END)").alias(f"_m_{f}") for f in FEATURES])
    total = sum(Z_WEIGHTS.values())
    score = " + ".join(f"coalesce(CASE WHEN _m_{f}.sd > 1e-9D THEN (CAST({f} AS DOUBLE) - _m_{f}.mu) / _m_{f}.sd * {wt}D / {total!r}D END, 0D)" for f, wt in Z_WEIGHTS.items())
    # One row per session: bounded by the calendar.
    return df.join(F.broadcast(wide), by, "left").selectExpr(*df.columns, f"{score} AS score")


def confidence_filter(df: DataFrame, min_score: float) -> DataFrame:
    return df.filter(F.col("score") >= min_score)


BEST = "round(score, 12) DESC, code"


def pick(df: DataFrame, n: int, by: str = "entry_date") -> DataFrame:
    """Best ``n`` per session. Scores equal to twelve digits are a tie, broken by code."""
    return top_n(df, n, by, BEST)


def active_cap_ratio(market: DataFrame, n: int = 20, least: int = 5) -> DataFrame:
    """Active cap over its own mean; 1 where the mean is missing. One row per session."""
    frame = f"OVER (ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    mean = f"CASE WHEN count(active_cap) {frame} >= {least} THEN avg(active_cap) {frame} END"
    return market.selectExpr("date", "active_cap", f"coalesce(try_divide(active_cap, {mean}), 1D) AS cap_ratio")


def overlay_score(
    df: DataFrame, kind: str, weight: float, by: str = "entry_date", ratio_max: float | None = None
) -> DataFrame:
    """Blend the score's daily rank with a turnover overlay: extreme, calm or mid.

    With ``ratio_max`` the overlay applies only where ``cap_ratio`` is at most that value.
    """
    overlay = (
        f"0.6D * {pct_rank_avg('turnover_extreme_score', by, 0.5)} + 0.25D * {pct_rank_avg('turnover_to_60d_max', by, 0.5)}"
        f" + 0.15D * {pct_rank_avg('volume_to_60d_max', by, 0.5)}"
    )
    out = df.selectExpr("*", f"{w.clip('1 - abs(coalesce(turnover_extreme_score, 0D) - 0.65D) / 0.65D', 0, 1)} AS _mid")
    if kind == "calm":
        overlay = f"1 - ({overlay})"
    elif kind == "mid":
        overlay = pct_rank_avg("_mid", by, 0.5)
    elif kind != "extreme":
        raise ValueError(f"unknown overlay: {kind}")
    out = out.selectExpr("*", f"{pct_rank_avg('score', by, 0.5)} AS _base", f"{overlay} AS overlay_score")
    blended = f"{(1 - weight)!r}D * _base + {weight!r}D * overlay_score"
    if ratio_max is not None:
        blended = f"CASE WHEN coalesce(cap_ratio, 1D) <= {ratio_max}D THEN {blended} ELSE _base END"
    keep = [c for c in df.columns if c != "score"]
    return out.selectExpr(*keep, "overlay_score", "score AS base_score", f"{blended} AS score")


def with_market(df: DataFrame, market: DataFrame, on: str = "signal_date") -> DataFrame:
    """Left join of one-row-per-session market values."""
    return df.join(market.withColumnRenamed("date", on), on, "left")


def market_regime_top_n(df: DataFrame, n: int, by: str = "entry_date") -> DataFrame:
    """Keep n, 70% of n or 40% of n rows per session as the cap ratio falls below 1 and 0.85."""
    low, mid = max(1, -(-n * 4 // 10)), max(1, -(-n * 7 // 10))
    keep = f"CASE WHEN cap_ratio < 0.85D THEN {low} WHEN cap_ratio < 1D THEN {mid} ELSE {n} END AS dynamic_n"
    return top_n(df.selectExpr("*", keep), n, by, BEST).filter("rank <= dynamic_n")


def softmax_weight(df: DataFrame, by: str = "entry_date") -> DataFrame:
    """Softmax of the score within a session, scaled so the weights add up to the group size."""
    d = w.group(by)
    out = df.selectExpr("*", f"exp(score - max(score) {d}) AS _e")
    return out.selectExpr("*", f"_e / sum(_e) {d} * count(1) {d} AS weight").drop("_e")
