"""Fund flows, concept strength, holding reluctance and large prints inside the candle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.quantiles import exact_quantiles
from tapeloom.functions.ranks import pct_rank_avg

# Quantile of the print amount by intensity.
INTENSITY = {"low": 0.75, "medium": 0.85, "high": 0.95}


def last_sessions(df: DataFrame, n: int) -> DataFrame:
    """Rows of the latest ``n`` distinct dates. The cut date is a scalar, so it reaches the scan."""
    cut = df.select("date").distinct().orderBy(F.desc("date")).limit(n).agg(F.min("date")).scalar()
    return df.filter(F.col("date") >= cut)


def _exact_sum(x: str) -> str:
    """Sum to six digits that does not depend on row order, so that equal totals tie."""
    return f"CAST(sum(CAST({x} AS DECIMAL(28, 6))) AS DOUBLE)"


def concept_flow(flow: DataFrame, bridge: DataFrame) -> DataFrame:
    """Flow of each block and date: the sums over its members."""
    return flow.join(bridge, "code").groupBy("block", "date").agg(
        *[F.expr(_exact_sum(c)).alias(c) for c in ("inflow", "outflow", "net_flow", "amount")]
    ).selectExpr("block AS concept", "date", "inflow", "outflow", "net_flow", "coalesce(try_divide(net_flow, amount) * 100, 0D) AS change_pct")


def concept_strength(flow: DataFrame, days: int = 5) -> DataFrame:
    """Net sum, win rate, slope, mean change and efficiency per concept, ranked into one score."""
    rows = last_sessions(flow, days).selectExpr("*", "row_number() OVER (PARTITION BY concept ORDER BY date) AS _i")
    per = rows.groupBy("concept").agg(
        F.count(F.lit(1)).alias("days"),
        F.expr(_exact_sum("net_flow")).alias("total_net"),
        F.avg(F.expr("CASE WHEN net_flow > 0 THEN 1D ELSE 0D END")).alias("win_rate"),
        F.expr("CASE WHEN count(1) >= 3 THEN coalesce(try_divide(covar_pop(net_flow, _i), var_pop(_i)), 0D) ELSE 0D END").alias("trend_slope"),
        F.avg("change_pct").alias("avg_change"),
        F.expr(f"coalesce(try_divide({_exact_sum('net_flow')}, {_exact_sum('inflow')} + {_exact_sum('outflow')}) * 100, 0D)").alias("net_efficiency"),
    )
    # One row per concept: the ranks below run over a table no longer than the list of concepts.
    parts = {"total_net": 35, "net_efficiency": 25, "avg_change": 20, "win_rate": 20}
    rounded = per.selectExpr("*", *[f"round({c}, 8) AS _{c}" for c in parts])
    score = " + ".join(f"{pct_rank_avg(f'_{c}', '1')} * {k}" for c, k in parts.items())
    return rounded.selectExpr(*per.columns, f"{score} AS strength_score")


def concept_alignment(strength: DataFrame, bridge: DataFrame, top: int = 20) -> DataFrame:
    """Share of a code's concepts that are among the strongest, x100."""
    main = strength.orderBy(F.expr("round(strength_score, 8)").desc(), "concept").limit(top).selectExpr("concept AS block", "true AS main")
    return bridge.join(F.broadcast(main), "block", "left").groupBy("code").agg(
        F.count(F.lit(1)).alias("total_concepts"), F.count_if(F.coalesce("main", F.lit(False))).alias("matched_concepts")
    ).selectExpr("*", "matched_concepts / total_concepts * 100 AS score", "matched_concepts > 0 AS in_mainline")


def holding_reluctance(flow: DataFrame, days: int = 5) -> DataFrame:
    """Slopes of net flow, outflow and turnover, steadiness of improvement, clamped score and trend."""
    rows = last_sessions(flow, days).selectExpr(
        "*",
        "row_number() OVER (PARTITION BY code ORDER BY date) AS _i",
        "net_flow > lag(net_flow) OVER (PARTITION BY code ORDER BY date) AS _better",
        "coalesce(try_divide(net_flow, inflow + outflow), 0D) AS _ratio",
    )

    def slope(x: str) -> str:
        return f"coalesce(try_divide(covar_pop({x}, _i), var_pop(_i)), 0D)"

    g = rows.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(slope("net_flow")).alias("net_slope"),
        F.expr(slope("outflow")).alias("out_slope"),
        F.expr(slope("turnover")).alias("turn_slope"),
        F.expr(slope("_ratio")).alias("ratio_slope"),
        F.expr("count_if(_better)").alias("_up"),
        F.expr("avg(abs(outflow))").alias("_ao"),
        F.expr("avg(abs(net_flow))").alias("_an"),
        F.expr("avg(turnover)").alias("_at"),
    ).filter("n >= 3")

    def part(s: str, base: str, k: int, sign: str) -> str:
        return f"CASE WHEN {base} > 0 THEN least({k}D, greatest(-{k}D, {sign}{s} / ({base} / n) * {k})) ELSE 0D END"

    score = f"50 + {part('out_slope', '_ao', 25, '-')} + {part('net_slope', '_an', 15, '')} + _up / (n - 1) * 10 + {part('turn_slope', '_at', 10, '-')}"
    return g.selectExpr(
        "code", "n", "net_slope", "out_slope", "turn_slope", "ratio_slope", "_up / (n - 1) AS consistency",
        f"greatest(0D, least(100D, {score})) AS reluctance_score",
        "CASE WHEN net_slope > 0.05 THEN 'shrinking' WHEN net_slope < -0.05 THEN 'expanding' ELSE 'flat' END AS trend",
    )


def reluctance_top(flow: DataFrame, days: int = 5, n: int = 50) -> DataFrame:
    """The most reluctant holders of the whole market."""
    return holding_reluctance(flow, days).orderBy(F.expr("round(reluctance_score, 8)").desc(), "code").limit(n)


def big_deal_threshold(deals: DataFrame, intensity: str = "medium", least: int = 10) -> DataFrame:
    """Amount quantile per code; 0 for codes with fewer than ``least`` prints."""
    sizes = deals.groupBy("code").agg(F.count("amount").alias("_n"))
    q = exact_quantiles(deals, ["code"], "amount", {"_q": INTENSITY[intensity]})
    return sizes.join(q, "code", "left").selectExpr("code", f"CASE WHEN _n >= {least} THEN _q ELSE 0D END AS threshold")


def located_deals(deals: DataFrame, bars: DataFrame, intensity: str = "medium", least: int = 20) -> DataFrame:
    """Large prints with their place in the day's candle: body or a wick."""
    enough = deals.groupBy("code").agg(F.count(F.lit(1)).alias("_n")).filter(f"_n >= {least}")
    limit = big_deal_threshold(deals, intensity).join(enough, "code", "left_semi")
    candle = bars.selectExpr("code", "date", "open", "close", "greatest(open, close) AS _hi", "least(open, close) AS _lo")
    return deals.join(limit, "code").filter("amount >= threshold").join(candle, ["code", "date"]).selectExpr(
        *deals.columns,
        "threshold",
        "CASE WHEN price > _hi THEN 'upper_wick' WHEN price < _lo THEN 'lower_wick' ELSE 'body' END AS position",
        "CASE WHEN close > open THEN 'bullish' WHEN close < open THEN 'bearish' ELSE 'flat' END AS candle",
    )


# Pattern name -> (direction, candle, position).
PATTERNS = {
    "buy_in_bear_wick": ("buy", "bearish", "lower_wick"),
    "sell_in_bear_body": ("sell", "bearish", "body"),
    "buy_in_bull_body": ("buy", "bullish", "body"),
    "sell_in_bull_wick": ("sell", "bullish", "upper_wick"),
}


def big_deal_patterns(deals: DataFrame, bars: DataFrame, intensity: str = "medium", least_big: int = 10) -> DataFrame:
    """Counts and amounts of the four print patterns, buy ratio, absorption score and buy zone."""
    rows = located_deals(deals, bars, intensity)
    aggs = []
    for name, (d, c, p) in PATTERNS.items():
        cond = f"direction = '{d}' AND candle = '{c}' AND position = '{p}'"
        aggs += [F.expr(f"count_if({cond})").alias(f"{name}_n"), F.expr(f"coalesce(sum(CASE WHEN {cond} THEN amount END), 0D)").alias(f"{name}_amt")]
    g = rows.groupBy("code").agg(
        F.count(F.lit(1)).alias("total_big_deals"),
        F.max("threshold").alias("threshold"),
        F.expr("coalesce(sum(CASE WHEN direction = 'buy' THEN amount END), 0D)").alias("total_buy"),
        F.expr("coalesce(sum(CASE WHEN direction = 'sell' THEN amount END), 0D)").alias("total_sell"),
        F.expr("avg(CASE WHEN direction = 'buy' THEN price END)").alias("_m"),
        F.expr("stddev_pop(CASE WHEN direction = 'buy' THEN price END)").alias("_s"),
        F.expr("count_if(direction = 'buy')").alias("_nb"),
        *aggs,
    ).filter(f"total_big_deals >= {least_big}")
    g = g.selectExpr("*", "coalesce(try_divide(total_buy, total_buy + total_sell) * 100, 50D) AS buy_ratio", "greatest(total_buy + total_sell, 1D) AS _all")
    score = (
        "50 + CASE WHEN buy_in_bear_wick_n > 0 THEN least(30D, buy_in_bear_wick_amt / _all * 200) ELSE 0D END"
        " + CASE WHEN buy_ratio > 50 THEN least(15D, (buy_ratio - 50) * 0.5) ELSE 0D END"
        " - CASE WHEN sell_in_bear_body_n > 0 AND buy_in_bear_wick_n = 0 THEN 10D ELSE 0D END"
        " + CASE WHEN buy_in_bull_body_n > 0 THEN least(10D, buy_in_bull_body_amt / _all * 100) ELSE 0D END"
        " - CASE WHEN sell_in_bull_wick_n > 0 THEN least(10D, sell_in_bull_wick_amt / _all * 100) ELSE 0D END"
    )
    spread = "CASE WHEN _nb > 1 THEN _s ELSE _m * 0.01 END"
    return g.selectExpr(
        "code", "total_big_deals", "threshold", "total_buy", "total_sell", "buy_ratio",
        *[f"{n}_n" for n in PATTERNS], *[f"{n}_amt" for n in PATTERNS],
        f"greatest(0D, least(100D, {score})) AS absorption_score",
        f"coalesce(_m - {spread}, 0D) AS buy_zone_low",
        f"coalesce(_m + {spread}, 0D) AS buy_zone_high",
        "CASE WHEN buy_ratio >= 50 THEN 'buy' ELSE 'sell' END AS dominant_direction",
    )


def washout_quality(patterns: DataFrame, bars: DataFrame) -> DataFrame:
    """Rate absorption together with the current price's place in the buy zone."""
    last = bars.groupBy("code").agg(F.max_by("close", "date").alias("_c"))
    return patterns.join(last, "code", "left").selectExpr(
        *patterns.columns,
        "buy_in_bear_wick_n > 0 AS has_absorption",
        "coalesce(buy_zone_low > 0 AND _c BETWEEN buy_zone_low AND buy_zone_high, false) AS price_in_zone",
    ).selectExpr(
        "*",
        "CASE WHEN total_big_deals < 10 THEN 'insufficient_data' WHEN has_absorption AND price_in_zone AND absorption_score >= 70 THEN 'excellent' "
        "WHEN has_absorption AND absorption_score >= 60 THEN 'good' WHEN absorption_score >= 50 THEN 'neutral' ELSE 'distribution_likely' END AS washout_quality",
    )


def concept_index(bars: DataFrame, bridge: DataFrame, least: int = 3) -> DataFrame:
    """Equal-weight member return per block and date; a member without a bar that day counts as 0."""
    ret = bars.selectExpr("code", "date", "close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret")
    sizes = bridge.groupBy("block").agg(F.count(F.lit(1)).alias("members")).filter(f"members >= {least}")
    return ret.join(bridge, "code").groupBy("block", "date").agg(F.sum("ret").alias("_s"), F.count("ret").alias("present")).join(
        sizes, "block"
    ).selectExpr("block", "date", "members", "present", "coalesce(_s, 0D) / members AS index_return")
