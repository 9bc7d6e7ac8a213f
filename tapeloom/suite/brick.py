"""Brick scan, labels, scores, picks and net value."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import windows as w
from tapeloom.functions.ranks import top_n_group_cap
from tapeloom.functions.scalars import limit_pct
from tapeloom.operators import brick, outcomes, scoring
from tapeloom.operators.brick import FEATURES
from tapeloom.plans import brick as plan
from tapeloom.sources import warehouse as wh
from tapeloom.suite.common import bars, out
from tapeloom.suite.sqlbase import ALL, S, cte, i, r, sql
from tapeloom.suite.sqlbase import w as sw

QUERIES, ORACLES = {}, {}

AHEAD = "(PARTITION BY code ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
AHEAD1 = "(PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"

cte(
    "feat",
    f"""SELECT *, CASE WHEN turnover_ratio_20 IS NULL THEN NULL ELSE 0.5*least(1, greatest(0, turnover_ratio_20/2)) END + 0.3*least(1, greatest(0, turnover_to_60d_max)) + 0.2*least(1, greatest(0, volume_to_60d_max)) AS turnover_extreme_score
FROM (SELECT *,
 (brick - coalesce(lag(brick, 3) OVER {S}, first_value(brick) OVER {S}))/3 AS brick_slope_3d,
 (brick - coalesce(lag(brick, 5) OVER {S}, first_value(brick) OVER {S}))/5 AS brick_slope_5d,
 brick AS brick_value, red_height/greatest(abs(green_height), 1e-6) AS red_green_ratio,
 {", ".join(f"CASE WHEN {c} > 0 THEN (close - {c})/{c}*100 ELSE 0 END AS close_to_{n}_pct" for c, n in (("yellow_line", "yellow"), ("white_line", "white"), ("ma5", "ma5"), ("ma10", "ma10"), ("ma20", "ma20"), ("ma60", "ma60")))},
 volume/greatest(vol_ma5, 1) AS vol_ratio_5, volume/greatest(vol_ma20, 1) AS vol_ratio_20,
 turnover/greatest(turnover_ma5, 1e-6) AS turnover_ratio_5, turnover/turnover_ma20 AS turnover_ratio_20,
 turnover/turnover_max60 AS turnover_to_60d_max, volume/max(volume) OVER {sw(60)} AS volume_to_60d_max,
 coalesce(pc > 0 AND (close - pc)/pc >= lim*0.99 AND abs(open - close)/pc < 0.001, false) AS one_word_up,
 coalesce(pc > 0 AND (close - pc)/pc <= -lim*0.99 AND abs(open - close)/pc < 0.001, false) AS one_word_down,
 coalesce(pc > 0 AND (open - pc)/pc >= lim*0.99, false) AS open_limit_up
FROM (SELECT *, CASE WHEN substring(code, 1, 2) IN ('30', '68') THEN 0.2 ELSE 0.1 END AS lim FROM bricks))""",
    "bricks",
)
cte(
    "trades",
    f"""SELECT * EXCLUDE (date, x, e_open, e_date, blocked), date AS signal_date,
 CASE WHEN coalesce(NOT blocked, false) AND x IS NOT NULL THEN 'closed' WHEN coalesce(NOT blocked, false) THEN 'open' ELSE 'blocked' END AS status,
 CASE WHEN NOT blocked THEN e_date END AS entry_date, CASE WHEN NOT blocked THEN e_open END AS entry_price,
 CASE WHEN NOT blocked THEN x.d END AS exit_date, CASE WHEN NOT blocked THEN x.c END AS exit_price,
 CASE WHEN NOT blocked THEN (x.c - e_open)/e_open*100 END AS return_pct, CASE WHEN NOT blocked THEN x.r - rn - 1 END AS hold_days
FROM (SELECT *, min(CASE WHEN brick < lb THEN sell END) OVER {AHEAD1} AS x FROM (
 SELECT *, min(CASE WHEN NOT one_word_down THEN {{'r': rn, 'd': date, 'c': close}} END) OVER {AHEAD} AS sell,
  lag(brick) OVER {S} AS lb, lead(open) OVER {S} AS e_open, lead(date) OVER {S} AS e_date, lead(open_limit_up) OVER {S} AS blocked FROM feat))
WHERE brick_signal""".replace("SELECT * EXCLUDE (date, x, e_open", "SELECT * EXCLUDE (date, x, sell, lb, e_open"),
    "feat",
)
cte("closed", "SELECT * FROM trades WHERE status = 'closed'", "trades")


def pr(x: str, by: str = "entry_date", default: str | None = "0.5") -> str:
    """Average-tie percentile rank, written with counts."""
    v = f"CAST({x} AS DOUBLE)"
    e = (
        f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {v} NULLS LAST) "
        f"+ (count(*) OVER (PARTITION BY {by}, {v}) - 1)/2.0)/count({v}) OVER (PARTITION BY {by}) END"
    )
    return f"coalesce({e}, {default})" if default is not None else e


DIMS = ", ".join(
    "(" + " + ".join(f"{wt}*{pr(f)}" for f, wt in ws.items()) + f")/{sum(ws.values())} AS dim_{n}"
    for n, ws in scoring.DIMENSION_FEATURES.items()
)
cte(
    "scored",
    f"""SELECT *, {" + ".join(f"{wt}*dim_{n}" for n, wt in scoring.DIMENSIONS.items())} AS score
FROM (SELECT *, {DIMS} FROM trades WHERE status <> 'blocked')""",
    "trades",
)

FLOAT_FEATURES = " ".join(f for f in FEATURES if f not in ("new_high_20d", "obv_trend_up", "macd_hist_rising"))
BOOL_FEATURES = "new_high_20d obv_trend_up macd_hist_rising"


def brick_features(spark, d):
    rows = plan.rows(bars(spark, d)).filter("brick_signal")
    return out(rows, f"code date {' '.join(FEATURES)} turnover_extreme_score turnover_to_60d_max volume_to_60d_max")


QUERIES["brick_features"] = brick_features
ORACLES["brick_features"] = sql(
    f"SELECT code, date, {r(FLOAT_FEATURES + ' turnover_extreme_score turnover_to_60d_max volume_to_60d_max')}, {i(BOOL_FEATURES)} FROM feat WHERE brick_signal",
    "feat",
)


def limit_predicates(spark, d):
    b = bars(spark, d)
    rows = brick.limit_flags(b.selectExpr("*", f"{w.ref('close')} AS pc"))
    return out(rows.selectExpr("code", "date", f"{limit_pct()} AS limit_pct", "one_word_up", "one_word_down", "open_limit_up"), "*")


QUERIES["limit_predicates"] = limit_predicates
ORACLES["limit_predicates"] = sql(
    f"SELECT code, date, CAST(lim AS DOUBLE) AS limit_pct, {i('one_word_up one_word_down open_limit_up')} FROM feat", "feat"
)


def entry_features(spark, d):
    rows = plan.rows(bars(spark, d))
    t1 = brick.entry_features(rows, "t1").filter("brick_signal")
    return out(t1, "code date overnight_gap_pct entry_open_to_yellow_pct entry_open_to_ma5_pct")


QUERIES["entry_features"] = entry_features
ORACLES["entry_features"] = sql(
    f"""SELECT code, date, {r("overnight_gap_pct entry_open_to_yellow_pct entry_open_to_ma5_pct")} FROM (
SELECT code, date, (eo - close)/close*100 AS overnight_gap_pct, (eo - y)/y*100 AS entry_open_to_yellow_pct, (eo - m)/m*100 AS entry_open_to_ma5_pct
FROM (SELECT *, coalesce(ly, yellow_line) + (eo - coalesce(lc, close))*(1/14.0 + 1/28.0 + 1/57.0 + 1/114.0)/4 AS y, coalesce(lm, ma5) + (eo - coalesce(lc, close))/5 AS m
FROM (SELECT *, coalesce(lead(open) OVER {S}, open) AS eo, lead(close) OVER {S} AS lc, lead(yellow_line) OVER {S} AS ly, lead(ma5) OVER {S} AS lm FROM bricks))
WHERE brick_signal)""",
    "bricks",
)


def brick_sequence_state(spark, d):
    rows = plan.rows(bars(spark, d))
    return out(
        brick.sequence_state(rows),
        "code date color brick_height same_color_exclusive reversal_recency prior_run_length run_length_ratio",
    )


QUERIES["brick_sequence_state"] = brick_sequence_state
cte(
    "nz",
    f"""SELECT code, date, sum(CASE WHEN pcol IS NULL OR pcol <> color THEN 1 ELSE 0 END) OVER {ALL} AS run FROM (
 SELECT *, lag(color) OVER {S} AS pcol FROM (SELECT code, date, sign(step) AS color FROM (
  SELECT code, date, brick - lag(brick) OVER {S} AS step FROM bricks) WHERE step <> 0))""",
    "bricks",
)
ORACLES["brick_sequence_state"] = sql(
    f"""SELECT code, date, {r("color brick_height run_length_ratio")}, same_color_exclusive, reversal_recency, prior_run_length FROM (
SELECT a.code, a.date, color, abs(step) AS brick_height, pos - 1 AS same_color_exclusive, pos AS reversal_recency, prior AS prior_run_length, pos/prior AS run_length_ratio
FROM (SELECT *, CAST(sign(step) AS DOUBLE) AS color FROM (SELECT code, date, brick - lag(brick) OVER {S} AS step FROM bricks)) a
LEFT JOIN (SELECT n.code, n.date, row_number() OVER (PARTITION BY n.code, n.run ORDER BY n.date) AS pos, p.len AS prior
  FROM nz n LEFT JOIN (SELECT code, run, count(*) AS len FROM nz GROUP BY ALL) p ON p.code = n.code AND p.run = n.run - 1) b USING (code, date))""",
    "nz",
)


def w_bottom(spark, d):
    rows = brick.w_bottom(plan.rows(bars(spark, d)), rows="brick_signal")
    names = [f"wbottom_{x}_{n}d" for n in (5, 10) for x in ("presence", "volume_contraction", "time_contraction", "retest_quality", "score")]
    return out(rows, "code date exhaustion_score", *names)


def _wb(n: int) -> str:
    """One row per signal and look-back: legs found by islands over the exploded window."""
    return f"""wb{n} AS MATERIALIZED (
 WITH pts AS (SELECT s.code, s.rn AS srn, b.rn, b.close, b.low, b.volume, lag(b.close) OVER (PARTITION BY s.code, s.rn ORDER BY b.rn) AS pc2,
   count(*) OVER (PARTITION BY s.code, s.rn) AS cnt
  FROM (SELECT code, rn FROM bricks WHERE brick_signal) s JOIN bricks b ON b.code = s.code AND b.rn BETWEEN s.rn - {n - 1} AND s.rn),
 dn AS (SELECT *, coalesce(close/pc2 - 1 < -0.001, false) AS down FROM pts),
 isl AS (SELECT *, sum(CASE WHEN down THEN 0 ELSE 1 END) OVER (PARTITION BY code, srn ORDER BY rn) AS g FROM dn),
 legs AS (SELECT code, srn, g, min(rn) - 1 AS s, max(rn) AS e, avg(volume) AS va, count(*) AS len, arg_max(low, rn) AS le
  FROM isl WHERE down AND cnt >= 4 GROUP BY ALL),
 two AS (SELECT code, srn, min(s) AS s1, arg_min(e, s) AS e1, arg_min(va, s) AS v1, arg_min(len, s) AS t1, arg_min(le, s) AS l1,
   max(s) AS s2, max(e) AS e2, arg_max(va, s) AS v2, arg_max(len, s) AS t2, arg_max(le, s) AS l2 FROM legs GROUP BY ALL),
 mid AS (SELECT t.*, (SELECT max(close) FROM bricks b WHERE b.code = t.code AND b.rn BETWEEN t.e1 AND t.s2) AS top,
   (SELECT close FROM bricks b WHERE b.code = t.code AND b.rn = t.e1) AS base, (SELECT close FROM bricks b WHERE b.code = t.code AND b.rn = t.srn) AS last
  FROM two t WHERE s2 > e1)
 SELECT code, srn, 1.0 AS presence, ln((v1 + 1)/(v2 + 1)) AS volume_contraction, ln((t1 + 1)/(t2 + 1)) AS time_contraction,
  greatest(-1, least(1, 1 - abs(l2 - l1)/greatest(abs(last), 1e-6))) AS retest_quality,
  greatest(0, ln((v1 + 1)/(v2 + 1)))*(0.5 + CASE WHEN v2 <= v1 THEN 0.25 ELSE 0 END + CASE WHEN t2 <= t1 THEN 0.25 ELSE 0 END)*greatest(0, greatest(-1, least(1, 1 - abs(l2 - l1)/greatest(abs(last), 1e-6)))) AS score
 FROM mid WHERE top/base - 1 > 0.002)"""


QUERIES["w_bottom"] = w_bottom
ORACLES["w_bottom"] = sql(
    "SELECT code, date, "
    + ", ".join(
        f"round(CAST(coalesce(w{n}.{x}, 0.0) AS DOUBLE), 6) + 0.0 AS wbottom_{x}_{n}d"
        for n in (5, 10)
        for x in ("presence", "volume_contraction", "time_contraction", "retest_quality", "score")
    )
    + ", round(CAST(0.6*coalesce(w5.score, 0.0) + 0.4*coalesce(w10.score, 0.0) AS DOUBLE), 6) + 0.0 AS exhaustion_score"
    + " FROM bricks b LEFT JOIN wb5 w5 ON w5.code = b.code AND w5.srn = b.rn LEFT JOIN wb10 w10 ON w10.code = b.code AND w10.srn = b.rn WHERE brick_signal",
    "bricks",
).replace("\nSELECT code, date,", f",\n{_wb(5)},\n{_wb(10)}\nSELECT b.code, b.date,", 1)


TRADE_COLS = "code signal_date status entry_date entry_price exit_date exit_price return_pct hold_days"


def label_trades(spark, d):
    return out(plan.trades(bars(spark, d)), TRADE_COLS)


QUERIES["label_trades"] = label_trades
ORACLES["label_trades"] = sql(
    f"SELECT code, signal_date, status, entry_date, exit_date, hold_days, {r('entry_price exit_price return_pct')} FROM trades", "trades"
)


def dimension_score(spark, d):
    return out(plan.scored(bars(spark, d)), "code entry_date dim_brick dim_position dim_trend dim_volume score")


QUERIES["dimension_score"] = dimension_score
ORACLES["dimension_score"] = sql(
    f"SELECT code, entry_date, {r('dim_brick dim_position dim_trend dim_volume score')} FROM scored", "scored"
)


def brick_top_picks(spark, d):
    return out(plan.top_picks(bars(spark, d)), f"{TRADE_COLS} score rank")


QUERIES["brick_top_picks"] = brick_top_picks
ORACLES["brick_top_picks"] = sql(
    f"""SELECT code, signal_date, status, entry_date, exit_date, hold_days, {r('entry_price exit_price return_pct score')}, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY entry_date ORDER BY round(score, 12) DESC, code) AS rank FROM scored) WHERE rank <= 3""",
    "scored",
)


def rolling_z_score(spark, d):
    t = plan.trades(bars(spark, d)).filter("status <> 'blocked'").select("code", "signal_date", "entry_date", *FEATURES)
    return out(scoring.rolling_z_score(t), "code entry_date score")


_zs = " + ".join(
    f"coalesce(CASE WHEN nd >= 10 AND n_{f} >= 10 AND sd_{f} > 1e-9 THEN (CAST({f} AS DOUBLE) - mu_{f})/sd_{f} END, 0)*{wt}/{sum(scoring.Z_WEIGHTS.values())}"
    for f, wt in scoring.Z_WEIGHTS.items()
)
QUERIES["rolling_z_score"] = rolling_z_score
ORACLES["rolling_z_score"] = sql(
    f"""SELECT code, entry_date, round({_zs}, 6) + 0.0 AS score FROM (SELECT * FROM trades WHERE status <> 'blocked') t
JOIN (SELECT a.entry_date, count(DISTINCT b.entry_date) AS nd, {", ".join(f"count({f}) AS n_{f}, avg(CAST({f} AS DOUBLE)) AS mu_{f}, stddev_samp(CAST({f} AS DOUBLE)) AS sd_{f}" for f in FEATURES)}
 FROM (SELECT DISTINCT entry_date, dense_rank() OVER (ORDER BY entry_date) AS dr FROM trades WHERE status <> 'blocked') a
 LEFT JOIN (SELECT *, dense_rank() OVER (ORDER BY entry_date) AS dr FROM trades WHERE status <> 'blocked') b ON b.dr BETWEEN a.dr - 60 AND a.dr - 1
 GROUP BY a.entry_date) h USING (entry_date)""",
    "trades",
)


def _overlay_input(spark, d):
    b = bars(spark, d)
    market = scoring.active_cap_ratio(plan.market_series(b))
    return scoring.with_market(plan.scored(b), market)


cte(
    "market",
    """SELECT date, active_cap, coalesce(CASE WHEN n >= 5 AND m <> 0 THEN active_cap/m END, 1.0) AS cap_ratio FROM (
SELECT *, count(*) OVER wn AS n, avg(active_cap) OVER wn AS m FROM (SELECT date, sum(amount) AS active_cap FROM bars GROUP BY date)
WINDOW wn AS (ORDER BY date ROWS 19 PRECEDING))""",
    "bars",
)


def active_cap_ratio(spark, d):
    m = scoring.active_cap_ratio(plan.market_series(bars(spark, d)))
    return out(m.withColumn("active_cap", F.round("active_cap", 2)), "date active_cap cap_ratio")


QUERIES["active_cap_ratio"] = active_cap_ratio
ORACLES["active_cap_ratio"] = sql("SELECT date, round(active_cap, 2) AS active_cap, round(cap_ratio, 6) + 0.0 AS cap_ratio FROM market", "market")


def overlay_score(spark, d):
    df = _overlay_input(spark, d)
    kinds = [
        scoring.overlay_score(df, kind, 0.15, ratio_max=limit).withColumn("kind", F.lit(kind))
        for kind, limit in (("extreme", None), ("calm", None), ("mid", 1.15))
    ]
    return out(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]), "code entry_date kind base_score overlay_score score")


_ov = f"(0.6*{pr('turnover_extreme_score')} + 0.25*{pr('turnover_to_60d_max')} + 0.15*{pr('volume_to_60d_max')})"
QUERIES["overlay_score"] = overlay_score
ORACLES["overlay_score"] = sql(
    f"""SELECT code, entry_date, kind, {r("base_score overlay_score score")} FROM (
SELECT code, entry_date, kind, score AS base_score, o AS overlay_score, CASE WHEN kind = 'mid' AND coalesce(cap_ratio, 1) > 1.15 THEN b ELSE 0.85*b + 0.15*o END AS score FROM (
 SELECT *, UNNEST([{{'kind': 'extreme', 'o': ov}}, {{'kind': 'calm', 'o': 1 - ov}}, {{'kind': 'mid', 'o': midr}}], recursive := true) FROM (
 SELECT *, {pr('score')} AS b, {_ov} AS ov, {pr('mid')} AS midr FROM (
  SELECT s.*, cap_ratio, greatest(0, least(1, 1 - abs(coalesce(turnover_extreme_score, 0) - 0.65)/0.65)) AS mid FROM scored s LEFT JOIN market m ON m.date = s.signal_date))))""",
    "scored",
    "market",
)


def market_regime_top_n(spark, d):
    return out(scoring.market_regime_top_n(_overlay_input(spark, d), 3), "code entry_date score cap_ratio dynamic_n rank")


QUERIES["market_regime_top_n"] = market_regime_top_n
ORACLES["market_regime_top_n"] = sql(
    f"""SELECT code, entry_date, {r("score cap_ratio")}, dynamic_n, CAST(rank AS INT) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY entry_date ORDER BY round(score, 12) DESC, code) AS rank,
 CASE WHEN coalesce(cap_ratio, 1) < 0.85 THEN 2 WHEN coalesce(cap_ratio, 1) < 1 THEN 3 ELSE 3 END AS dynamic_n
FROM scored s LEFT JOIN market m ON m.date = s.signal_date) WHERE rank <= dynamic_n""",
    "scored",
    "market",
)


def group_cap_picks(spark, d):
    s = plan.scored(bars(spark, d)).join(wh.industry(spark, d), "code", "left")
    return out(
        top_n_group_cap(s, 5, 1, "entry_date", "industry", scoring.BEST), "code entry_date industry score rank"
    )


QUERIES["group_cap_picks"] = group_cap_picks
ORACLES["group_cap_picks"] = sql(
    f"""SELECT code, entry_date, industry, {r("score")}, CAST(rank AS INT) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY entry_date ORDER BY round(score, 12) DESC, code) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY entry_date, industry ORDER BY round(score, 12) DESC, code) AS in_group FROM scored LEFT JOIN industry USING (code)) WHERE in_group = 1) WHERE rank <= 5""",
    "scored",
    "industry",
)


def softmax_weights(spark, d):
    s = scoring.confidence_filter(plan.scored(bars(spark, d)), 0.4)
    return out(scoring.softmax_weight(s), "code entry_date score weight")


QUERIES["softmax_weights"] = softmax_weights
ORACLES["softmax_weights"] = sql(
    f"""SELECT code, entry_date, {r("score weight")} FROM (SELECT *, exp(score)/sum(exp(score)) OVER d * count(*) OVER d AS weight
FROM scored WHERE score >= 0.4 WINDOW d AS (PARTITION BY entry_date))""",
    "scored",
)


def trade_metrics(spark, d):
    return out(outcomes.trade_metrics(plan.closed_trades(bars(spark, d)), ["code"]), "*")


QUERIES["trade_metrics"] = trade_metrics
ORACLES["trade_metrics"] = sql(
    f"""SELECT code, trades, entry_days, {r("win_rate_pct avg_return_pct median_return_pct std_return_pct avg_hold_days")} FROM (
SELECT code, count(*) AS trades, count(DISTINCT entry_date) AS entry_days, 100*avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0 END) AS win_rate_pct,
avg(return_pct) AS avg_return_pct, median(return_pct) AS median_return_pct, coalesce(stddev_samp(return_pct), 0) AS std_return_pct, avg(hold_days) AS avg_hold_days FROM closed GROUP BY code)""",
    "closed",
)


def monthly_stats(spark, d):
    return out(outcomes.monthly_stats(plan.closed_trades(bars(spark, d))), "*")


QUERIES["monthly_stats"] = monthly_stats
ORACLES["monthly_stats"] = sql(
    f"""SELECT month, n, {r("win_rate_pct avg_return_pct")} FROM (SELECT CAST(date_trunc('month', entry_date) AS DATE) AS month, count(*) AS n,
100*avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0 END) AS win_rate_pct, avg(return_pct) AS avg_return_pct FROM closed GROUP BY 1)""",
    "closed",
)

cte(
    "held",
    """SELECT t.*, CAST(u.dd AS DATE) AS day FROM closed t, UNNEST(generate_series(entry_date::TIMESTAMP, exit_date::TIMESTAMP, INTERVAL 1 DAY)) AS u(dd) WHERE isodow(u.dd) < 6""",
    "closed",
)
cte(
    "posret",
    f"""SELECT h.code, h.entry_date, h.exit_date, h.day, CASE WHEN h.day = h.entry_date AND h.day = h.exit_date THEN exit_price/entry_price - 1
 WHEN h.day = h.entry_date THEN m.close/entry_price - 1 WHEN h.day = h.exit_date THEN exit_price/prev - 1 ELSE cur/prev - 1 END AS ret
FROM (SELECT h.*, m.close AS cur, CASE WHEN m.date = h.day THEN m.pc ELSE m.close END AS prev FROM held h
 ASOF JOIN (SELECT code, date, close, lag(close) OVER {S} AS pc FROM bars) m ON h.code = m.code AND h.day >= m.date) h
ASOF JOIN bars m ON h.code = m.code AND h.day >= m.date""",
    "held",
    "bars",
)
cte(
    "daily",
    """SELECT day, coalesce(active, 0) AS active, coalesce(gross, 0) - coalesce(cost, 0)/greatest(1, coalesce(active, 0)) AS ret
FROM (SELECT CAST(u.dd AS DATE) AS day FROM (SELECT min(entry_date) AS a, max(exit_date) AS b FROM closed), UNNEST(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS u(dd) WHERE isodow(u.dd) < 6)
LEFT JOIN (SELECT day, avg(ret) AS gross, count(*) AS active FROM posret GROUP BY day) USING (day)
LEFT JOIN (SELECT day, sum(cost) AS cost FROM (SELECT entry_date AS day, 0.00125 AS cost FROM closed UNION ALL SELECT exit_date, 0.00175 FROM closed) GROUP BY day) USING (day)""",
    "posret",
)
cte(
    "nav",
    """SELECT *, nav/max(nav) OVER (ORDER BY day) - 1 AS drawdown FROM (SELECT *, product(1 + ret) OVER (ORDER BY day) AS nav FROM daily)""",
    "daily",
)


def active_position_returns(spark, d):
    b = bars(spark, d)
    return out(outcomes.position_returns(plan.closed_trades(b), b), "code entry_date exit_date day ret")


QUERIES["active_position_returns"] = active_position_returns
ORACLES["active_position_returns"] = sql(f"SELECT code, entry_date, exit_date, day, {r('ret')} FROM posret", "posret")


def _log_nav(nav):
    """Prices of the given tables jump by multiples, so net value is compared as its logarithm."""
    return nav.selectExpr("*", "ln(nav) AS log_nav")


def _log_pct(df, *names):
    return df.selectExpr(*[f"100 * ln(1 + {c} / 100) AS {c}" if c in names else c for c in df.columns])


def signal_quality_nav(spark, d):
    b = bars(spark, d)
    return out(_log_nav(outcomes.add_nav(outcomes.daily_returns(plan.closed_trades(b), b))), "day active ret log_nav drawdown")


QUERIES["signal_quality_nav"] = signal_quality_nav
ORACLES["signal_quality_nav"] = sql(f"SELECT day, active, {r('ret log_nav drawdown')} FROM (SELECT *, ln(nav) AS log_nav FROM nav)", "nav")


def nav_metrics(spark, d):
    b = bars(spark, d)
    return out(_log_pct(outcomes.nav_metrics(outcomes.daily_returns(plan.closed_trades(b), b)), "cum_return_pct", "cagr_pct").drop("sharpe", "calmar"), "*")


NAV_METRICS = """SELECT days, (l - 1)*100 AS cum_return_pct, ann*100 AS cagr_pct, dd*100 AS max_drawdown_pct, CASE WHEN vol > 0 THEN (ann - 0.02)/vol ELSE 0 END AS sharpe,
 CASE WHEN dd < 0 THEN ann/abs(dd) ELSE 0 END AS calmar, daily_win_pct, daily_avg_pct FROM (SELECT *, CASE WHEN l > 0 THEN pow(l, 252.0/days) - 1 ELSE -1 END AS ann FROM (
SELECT count(*) AS days, arg_max(nav, day) AS l, min(drawdown) AS dd, stddev_samp(ret)*sqrt(252) AS vol, 100*avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS daily_win_pct, 100*avg(ret) AS daily_avg_pct FROM nav))"""
QUERIES["nav_metrics"] = nav_metrics
ORACLES["nav_metrics"] = sql(
    f"SELECT days, {r('cum_return_pct cagr_pct max_drawdown_pct daily_win_pct daily_avg_pct')} FROM (SELECT * REPLACE (100*ln(1 + cum_return_pct/100) AS cum_return_pct, 100*ln(1 + cagr_pct/100) AS cagr_pct) FROM ({NAV_METRICS}))", "nav"
)


def drawdown_and_monthly_sharpe(spark, d):
    b = bars(spark, d)
    return out(_log_pct(outcomes.drawdown_and_monthly_sharpe(outcomes.daily_returns(plan.closed_trades(b), b)), "total_return_pct"), "*")


MONTHLY = """SELECT count(ret) AS months, min(dd)*100 AS max_drawdown_pct, 100*ln(arg_max(nav, month)) AS total_return_pct, coalesce(avg(ret)/stddev_samp(ret)*sqrt(12), 0) AS monthly_sharpe
FROM (SELECT *, nav/lag(nav) OVER (ORDER BY month) - 1 AS ret FROM (SELECT date_trunc('month', day) AS month, arg_max(nav, day) AS nav, min(drawdown) AS dd FROM nav GROUP BY 1))"""
QUERIES["drawdown_and_monthly_sharpe"] = drawdown_and_monthly_sharpe
ORACLES["drawdown_and_monthly_sharpe"] = sql(f"SELECT months, {r('max_drawdown_pct total_return_pct monthly_sharpe')} FROM ({MONTHLY})", "nav")


def stitched_nav(spark, d):
    b = bars(spark, d)
    t = plan.closed_trades(b)
    return out(_log_nav(outcomes.stitch_nav(_folds(t, b))), "day active ret log_nav drawdown")


def _folds(t, b):
    """Daily returns of two consecutive out-of-sample windows of the trades."""
    cut = "1999-01-01"
    a = outcomes.daily_returns(t.filter(F.col("entry_date") < cut), b).withColumn("fold", F.lit(1))
    z = outcomes.daily_returns(t.filter(F.col("entry_date") >= cut), b).withColumn("fold", F.lit(2))
    return a.unionByName(z)


def _daily_sql(where: str) -> str:
    return f"""(SELECT day, coalesce(active, 0) AS active, coalesce(gross, 0) - coalesce(cost, 0)/greatest(1, coalesce(active, 0)) AS ret
FROM (SELECT CAST(u.dd AS DATE) AS day FROM (SELECT min(entry_date) AS a, max(exit_date) AS b FROM closed WHERE {where}), UNNEST(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS u(dd) WHERE isodow(u.dd) < 6)
LEFT JOIN (SELECT day, avg(ret) AS gross, count(*) AS active FROM posret WHERE {where} GROUP BY day) USING (day)
LEFT JOIN (SELECT day, sum(cost) AS cost FROM (SELECT entry_date AS day, 0.00125 AS cost FROM closed WHERE {where} UNION ALL SELECT exit_date, 0.00175 FROM closed WHERE {where}) GROUP BY day) USING (day))"""


QUERIES["stitched_nav"] = stitched_nav
ORACLES["stitched_nav"] = sql(
    f"""SELECT day, active, {r("ret log_nav drawdown")} FROM (SELECT *, ln(nav) AS log_nav, nav/max(nav) OVER (ORDER BY day) - 1 AS drawdown FROM (SELECT *, product(1 + ret) OVER (ORDER BY day) AS nav FROM (
SELECT day, arg_min(ret, f) AS ret, arg_min(active, f) AS active FROM (SELECT *, 1 AS f FROM {_daily_sql("entry_date < '1999-01-01'")} UNION ALL SELECT *, 2 FROM {_daily_sql("entry_date >= '1999-01-01'")}) GROUP BY day)))""",
    "posret",
)


def strategy_metrics(spark, d):
    b = bars(spark, d)
    t = plan.closed_trades(b)
    curve = _log_pct(outcomes.drawdown_and_monthly_sharpe(outcomes.daily_returns(t, b)), "total_return_pct")
    m = outcomes.strategy_metrics(t)
    joined = m.withColumns({c: curve.select(c).scalar() for c in ("max_drawdown_pct", "total_return_pct", "monthly_sharpe")})
    return out(outcomes.composite_score(joined), "*")


STRATEGY = f"""SELECT *, CASE WHEN total_trades >= 30 THEN total_return_pct*0.25 + monthly_sharpe*60*0.18 + least(profit_factor, 5)*12*0.15 + (100 - abs(max_drawdown_pct))*0.08
 + least(win_rate, 55)*0.15 + least(total_trades, 300)*0.07 + least(wl_ratio, 5)*4*0.07 + least(60 - abs(top10_share_pct - 90), 40)*0.05 ELSE 0 END AS score FROM (
SELECT total_trades, winning_trades, losing_trades, winning_trades/total_trades*100 AS win_rate, coalesce(avg_win, 0) AS avg_win, coalesce(avg_loss, 0) AS avg_loss,
 coalesce(abs(avg_win/avg_loss), 99) AS wl_ratio, coalesce(abs(gp/gl), 99) AS profit_factor, avg_hold_win, avg_hold_loss, best_code, best_pct, worst_code, worst_pct, top10/total*100 AS top10_share_pct, c.* EXCLUDE (months)
FROM (SELECT count(*) AS total_trades, count(*) FILTER (return_pct > 0) AS winning_trades, count(*) FILTER (return_pct <= 0) AS losing_trades, avg(return_pct) FILTER (return_pct > 0) AS avg_win,
 avg(return_pct) FILTER (return_pct <= 0) AS avg_loss, sum(return_pct) FILTER (return_pct > 0) AS gp, sum(return_pct) FILTER (return_pct <= 0) AS gl, sum(return_pct) AS total,
 avg(hold_days) FILTER (return_pct > 0) AS avg_hold_win, avg(hold_days) FILTER (return_pct <= 0) AS avg_hold_loss, arg_max(code, return_pct) AS best_code, max(return_pct) AS best_pct,
 arg_min(code, return_pct) AS worst_code, min(return_pct) AS worst_pct FROM closed),
 (SELECT sum(return_pct) AS top10 FROM (SELECT return_pct FROM closed ORDER BY return_pct DESC LIMIT 10)), ({MONTHLY}) c)"""
QUERIES["strategy_metrics"] = strategy_metrics
ORACLES["strategy_metrics"] = sql(
    f"""SELECT total_trades, winning_trades, losing_trades, best_code, worst_code,
{r("win_rate avg_win avg_loss wl_ratio profit_factor avg_hold_win avg_hold_loss best_pct worst_pct top10_share_pct max_drawdown_pct total_return_pct monthly_sharpe score")} FROM ({STRATEGY})""",
    "nav",
)

TARGETS = {"win_rate": 45.0, "profit_factor": 1.5, "avg_win": 20.0, "worst_pct": 60.0}


def compare_to_target(spark, d):
    t = plan.closed_trades(bars(spark, d))
    return out(outcomes.compare_to_target(outcomes.strategy_metrics(t), TARGETS, ("worst_pct",)), "*")


QUERIES["compare_to_target"] = compare_to_target
ORACLES["compare_to_target"] = sql(
    f"""SELECT metric, {r("current target delta")}, CASE WHEN delta > 0 THEN 'WIN' ELSE 'LOSE' END AS status, round(CAST(avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0 END) OVER () AS DOUBLE), 6) AS win_share FROM (
SELECT metric, current, target, CASE WHEN metric = 'worst_pct' THEN target - current ELSE current - target END AS delta FROM (
SELECT UNNEST([{{'metric': 'win_rate', 'current': win_rate, 'target': 45.0}}, {{'metric': 'profit_factor', 'current': profit_factor, 'target': 1.5}}, {{'metric': 'avg_win', 'current': avg_win, 'target': 20.0}}, {{'metric': 'worst_pct', 'current': abs(worst_pct), 'target': 60.0}}], recursive := true)
FROM ({STRATEGY})))""",
    "nav",
)


def exit_rules(spark, d):
    rows = plan.rows(bars(spark, d))
    t = outcomes.label_trades(rows).filter("status <> 'blocked'")
    t = t.select("code", "entry_date", "entry_price", (F.col("rn") + 1).alias("entry_rn"), (F.col("low") * 0.9).alias("stop_price"))
    return out(outcomes.exit_rules(t, rows), "*")


QUERIES["exit_rules"] = exit_rules


def distribution_exit(spark, d):
    rows = plan.rows(bars(spark, d))
    t = outcomes.label_trades(rows).filter("status <> 'blocked'").selectExpr("code", "rn + 1 AS entry_rn")
    seen = outcomes.distribution_exit(outcomes.trade_paths(t, rows, 60))
    return out(seen.filter("rn > entry_rn"), "code entry_rn rn s1")


QUERIES["distribution_exit"] = distribution_exit
# Distribution since the entry: pairs of a session n and an earlier bar i of the trade, and the three highest bars t up to n.
cte("s1path", f"""SELECT t.code, t.rn + 1 AS ern, b.rn, b.open, b.high, b.low, b.close, b.volume, b.ma5 > b.ma10 AND b.ma10 > b.ma20 AND b.close <= b.open AND b.low < b.high AS bear, b.pv, e.close AS eclose
FROM (SELECT * FROM trades WHERE status <> 'blocked') t JOIN (SELECT *, lag(volume) OVER (PARTITION BY code ORDER BY rn) AS pv FROM feat) b ON b.code = t.code AND b.rn BETWEEN t.rn + 1 AND t.rn + 61 JOIN feat e ON e.code = t.code AND e.rn = t.rn + 1""", "trades", "feat")
cte("s1day", """SELECT n.code, n.ern, n.rn AS n, max(p.close)/any_value(n.eclose) - 1 AS best, max(p.volume) FILTER (p.close > p.open) AS bull, max(p.high) FILTER (p.rn > n.rn - 20) AS hi, min(p.low) FILTER (p.rn > n.rn - 20) AS lo
FROM s1path n JOIN s1path p ON p.code = n.code AND p.ern = n.ern AND p.rn <= n.rn GROUP BY 1, 2, 3""", "s1path")
cte("s1top", """SELECT code, ern, n, t FROM (SELECT n.code, n.ern, n.rn AS n, p.rn AS t, row_number() OVER (PARTITION BY n.code, n.ern, n.rn ORDER BY p.high DESC, p.rn) AS k FROM s1path n JOIN s1path p ON p.code = n.code AND p.ern = n.ern AND p.rn <= n.rn) WHERE k <= 3""", "s1path")
cte("s1bar", """SELECT p.code, p.ern, p.rn AS i, p.close, p.volume, coalesce(p.volume/p.pv >= 1.5, false) OR coalesce(p.volume/avg(q.volume) >= 2, false) AS heavy
FROM s1path p LEFT JOIN s1path q ON q.code = p.code AND q.ern = p.ern AND q.rn BETWEEN p.rn - 20 AND p.rn - 1 WHERE p.bear GROUP BY p.code, p.ern, p.rn, p.close, p.volume, p.pv""", "s1path")
cte("s1", """SELECT DISTINCT d.code, d.ern, d.n, true AS s1 FROM s1day d JOIN s1bar b ON b.code = d.code AND b.ern = d.ern AND b.i <= d.n
WHERE best >= 0.04 AND d.n > d.ern AND (heavy OR coalesce(bull > 0 AND b.volume >= bull*0.9, false))
 AND ((hi > lo AND (b.close - lo)/(hi - lo) >= 0.7) OR EXISTS (SELECT 1 FROM s1top t WHERE t.code = d.code AND t.ern = d.ern AND t.n = d.n AND b.i - t.t BETWEEN 1 AND 3))""", "s1day", "s1bar", "s1top")
ORACLES["distribution_exit"] = sql("SELECT p.code, p.ern AS entry_rn, p.rn, CAST(coalesce(s1, false) AS INT) AS s1 FROM s1path p LEFT JOIN s1 s ON s.code = p.code AND s.ern = p.ern AND s.n = p.rn WHERE p.rn > p.ern", "s1path", "s1")
ORACLES["exit_rules"] = sql(
    f"""SELECT code, entry_date, {r("entry_price exit_price profit_pct")}, CAST(launched_in_path AS INT) AS launched_in_path, exit_reason, exit_date FROM (
SELECT code, any_value(entry_date) AS entry_date, any_value(entry_price) AS entry_price, coalesce(arg_min(launched, rn) FILTER (reason IS NOT NULL), bool_or(launched)) AS launched_in_path,
 arg_min(reason, rn) FILTER (reason IS NOT NULL) AS exit_reason, arg_min(date, rn) FILTER (reason IS NOT NULL) AS exit_date,
 arg_min(price, rn) FILTER (reason IS NOT NULL) AS exit_price, (exit_price/any_value(entry_price) - 1)*100 AS profit_pct
FROM (SELECT *, CASE WHEN reason = 'stop_loss' THEN stop WHEN reason IS NOT NULL THEN close END AS price FROM (
SELECT *, CASE WHEN low <= stop THEN 'stop_loss' WHEN days >= 3 AND gain < 0.02 THEN 'weak' WHEN close < yellow_line THEN 'break_yellow'
 WHEN launched AND close < white_line THEN 'break_white' WHEN launched AND gain > 0.25 THEN 'target' WHEN s1 THEN 'S1' WHEN days >= 60 THEN 'max_hold' END AS reason FROM (
SELECT *, bool_or(gain > 0.05 AND close > white_line) OVER (PARTITION BY code, ern ORDER BY rn) AS launched FROM (
SELECT t.code, t.entry_date, t.entry_price, t.rn + 1 AS ern, t.low*0.9 AS stop, b.rn, b.date, b.low, b.close, b.white_line, b.yellow_line, b.close/t.entry_price - 1 AS gain, b.date - t.entry_date AS days, coalesce(s.s1, false) AS s1
FROM (SELECT * FROM trades WHERE status <> 'blocked') t JOIN feat b ON b.code = t.code AND b.rn BETWEEN t.rn + 2 AND t.rn + 61 LEFT JOIN s1 s ON s.code = t.code AND s.ern = t.rn + 1 AND s.n = b.rn))))
GROUP BY code, ern)""",
    "trades",
    "s1",
)


def stale_valuation(spark, d):
    b = bars(spark, d)
    return out(outcomes.stale_valuation(b, b.select("date").distinct()), "*")


QUERIES["stale_valuation"] = stale_valuation
ORACLES["stale_valuation"] = sql(
    f"""SELECT code, date, {r("value")}, CAST(stale AS INT) AS stale FROM (SELECT c.code, c.date, b.close AS value, b.date <> c.date AS stale
FROM (SELECT code, date FROM (SELECT code, min(date) AS a FROM bars GROUP BY code), (SELECT DISTINCT date FROM bars) WHERE date >= a) c
ASOF JOIN bars b ON b.code = c.code AND c.date >= b.date)""",
    "bars",
)
