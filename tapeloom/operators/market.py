"""Market-wide series, timing states and regimes. One row per session after the first aggregate,
so the ordered windows below hold at most the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import windows as w

DATES = "ORDER BY date"


def _rows(n: int, skip: int = 0) -> str:
    end = f"{skip} PRECEDING" if skip else "CURRENT ROW"
    return f"OVER ({DATES} ROWS BETWEEN {n - 1 + skip} PRECEDING AND {end})"


def market_daily_state(bars: DataFrame, lookback: int = 20, least: int = 15) -> DataFrame:
    """Per session: amount, advancers, decliners, and rows whose volume tops their rolling median."""
    rows = bars.selectExpr(
        "date",
        "close",
        "amount",
        "volume",
        f"{w.ref('close')} AS prev",
        f"percentile(volume, 0.5) {w.rows(lookback)} AS med",
        f"count(volume) {w.rows(lookback)} AS obs",
    )
    return rows.groupBy("date").agg(
        F.expr("sum(CASE WHEN amount >= 0 THEN amount END)").alias("total_amount"),
        F.expr("count_if(close > prev)").alias("advancers"),
        F.expr("count_if(close < prev)").alias("decliners"),
        F.expr(f"count_if(obs >= {least} AND volume > med)").alias("participants"),
        F.expr(f"count_if(obs >= {least})").alias("participation_eligible"),
        F.expr("count_if(amount >= 0)").alias("amount_rows"),
        F.count(F.lit(1)).alias("universe_rows"),
    )


def market_state_percentiles(daily: DataFrame, n: int = 60, least: int = 20) -> DataFrame:
    """Rolling percentile ranks of amount, advance share and breadth, their mean, and coverages."""
    out = daily.selectExpr(
        "*",
        "try_divide(advancers, advancers + decliners) AS advance_ratio",
        "try_divide(participants, participation_eligible) AS breadth",
    )

    def rank(x: str) -> str:
        v = f"collect_list({x}) {_rows(n)}"
        return (
            f"CASE WHEN {x} IS NOT NULL AND size({v}) >= {least} THEN (size(filter({v}, y -> y < {x})) "
            f"+ (size(filter({v}, y -> y = {x})) + 1) / 2D) / size({v}) END"
        )

    parts = {"amount_pctile": "total_amount", "advance_pctile": "advance_ratio", "breadth_pctile": "breadth"}
    out = out.selectExpr("*", *[f"{rank(x)} AS {n_}" for n_, x in parts.items()])
    present = " + ".join(f"CAST({p} IS NOT NULL AS INT)" for p in parts)
    total = " + ".join(f"coalesce({p}, 0D)" for p in parts)
    return out.selectExpr(
        "*",
        f"try_divide({total}, {present}) AS state_score",
        "try_divide(amount_rows, universe_rows) AS amount_coverage",
        "try_divide(participation_eligible, universe_rows) AS participation_coverage",
    )


def market_timing(series: DataFrame, bearish: float = -2.3, bullish: float = 4.0) -> DataFrame:
    """Bearish after a fall, bullish after a rise of one day or two days together; else unchanged.

    ``series`` has (date, active_cap). The first state is bearish.
    """
    out = series.selectExpr("date", "active_cap", f"(active_cap / lag(active_cap) OVER ({DATES}) - 1) * 100 AS pct_chg")
    event = (
        f"CASE WHEN pct_chg <= {bearish} THEN 'bearish' WHEN pct_chg >= {bullish} "
        f"OR pct_chg + lag(pct_chg) OVER ({DATES}) >= {bullish} THEN 'bullish' END"
    )
    out = out.selectExpr("*", f"{event} AS event")
    state = f"last(event, true) OVER ({DATES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return out.selectExpr("date", "active_cap", "pct_chg", f"coalesce({state}, 'bearish') AS state")


def state_on(rows: DataFrame, states: DataFrame, on: str) -> DataFrame:
    """State in force on each row's date: the latest known one, bearish before the first.

    States are spread over the calendar days they cover, so the lookup is an equi-join on the date
    against a table no longer than the calendar.
    """
    last = rows.agg(F.max(on)).scalar()
    spans = states.selectExpr("date", "state", f"lead(date) OVER ({DATES}) AS _next").withColumn("_last", last)
    days = spans.selectExpr(
        f"explode(sequence(date, coalesce(date_sub(_next, 1), greatest(date, _last)))) AS {on}", "state"
    )
    return rows.join(days, on, "left").selectExpr(*rows.columns, "coalesce(state, 'bearish') AS state")


def regime_intervals(states: DataFrame) -> DataFrame:
    """Days, number of runs and mean run length of each state."""
    out = states.selectExpr("*", f"coalesce(state <> lag(state) OVER ({DATES}), true) AS _new")
    return out.groupBy("state").agg(F.count(F.lit(1)).alias("days"), F.count_if("_new").alias("runs")).selectExpr(
        "*", "days / runs AS mean_run"
    )


def near_pct_by_regime(df: DataFrame, bullish: float, bearish: float) -> DataFrame:
    """Position test whose tolerance switches with the market state."""
    tol = f"CASE state WHEN 'bullish' THEN {bullish}D ELSE {bearish}D END"
    return df.selectExpr(
        "*",
        f"(close >= yellow_line AND close <= white_line) OR abs(close - white_line) / white_line * 100 <= {tol} AS position_ok",
    )


def bear_override(df: DataFrame, min_score: float = 90.0) -> DataFrame:
    """In a bearish state keep only rows scoring at least ``min_score``."""
    return df.filter(f"state <> 'bearish' OR score >= {min_score}")


def volume_authenticity(bars: DataFrame) -> DataFrame:
    """Own and market contraction of volume (5 rows over the 15 before), their ratio and daily rank."""
    from tapeloom.functions.ranks import pct_rank_avg

    def contraction(x: str, recent: str, prior: str, seen: str) -> str:
        return f"CASE WHEN {seen} >= 20 THEN try_divide({recent}, {prior}) END"

    own = bars.selectExpr(
        "code",
        "date",
        contraction("volume", f"avg(volume) {w.rows(5)}", f"avg(volume) {w.rows(15, 5)}", f"count(volume) {w.rows(20)}")
        + " AS stock_contraction",
    )
    market = bars.groupBy("date").agg(F.sum("volume").alias("market_volume")).selectExpr(
        "date",
        "market_volume",
        contraction("", f"avg(market_volume) {_rows(5)}", f"avg(market_volume) {_rows(15, 5)}", f"count(1) {_rows(20)}")
        + " AS market_contraction",
    )
    out = own.join(market, "date", "left").selectExpr("*", "try_divide(stock_contraction, market_contraction) AS ratio")
    return out.filter("ratio IS NOT NULL").selectExpr("*", f"{pct_rank_avg('ratio', 'date')} AS authenticity_rank")
