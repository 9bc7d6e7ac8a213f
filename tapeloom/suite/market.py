"""Market state and timing (A1, A2, H22-H25), peers, sectors, pools and the factor library."""

from __future__ import annotations

from tapeloom.operators import brick, market, pools, scoring
from tapeloom.operators import indicators as ind
from tapeloom.plans import brick as plan
from tapeloom.session import cut_lineage
from tapeloom.sources import warehouse as wh
from tapeloom.suite.brick import pr
from tapeloom.suite.common import bars, indicators, out
from tapeloom.suite.sqlbase import S, cte, i, r, sql
from tapeloom.suite.sqlbase import w as sw

QUERIES, ORACLES = {}, {}

cte(
    "mds",
    f"""SELECT date, sum(CASE WHEN amount >= 0 THEN amount END) AS total_amount, count(*) FILTER (close > prev) AS advancers, count(*) FILTER (close < prev) AS decliners,
 count(*) FILTER (obs >= 15 AND volume > med) AS participants, count(*) FILTER (obs >= 15) AS participation_eligible, count(*) FILTER (amount >= 0) AS amount_rows, count(*) AS universe_rows
FROM (SELECT *, lag(close) OVER {S} AS prev, median(volume) OVER {sw(20)} AS med, count(volume) OVER {sw(20)} AS obs FROM bars) GROUP BY date""",
    "bars",
)


def market_daily_state(spark, d):
    return out(market.market_daily_state(bars(spark, d)), "*", n=2)


QUERIES["market_daily_state"] = market_daily_state
ORACLES["market_daily_state"] = sql(
    "SELECT date, round(total_amount, 2) + 0.0 AS total_amount, advancers, decliners, participants, participation_eligible, amount_rows, universe_rows FROM mds", "mds"
)


def _rk(x):
    v = f"list({x}) OVER f"
    return f"CASE WHEN {x} IS NOT NULL AND len(list_filter({v}, lambda y: y IS NOT NULL)) >= 20 THEN (len(list_filter({v}, lambda y: y < {x})) + (len(list_filter({v}, lambda y: y = {x})) + 1)/2.0)/len(list_filter({v}, lambda y: y IS NOT NULL)) END"


cte(
    "msp",
    f"""SELECT *, (coalesce(amount_pctile, 0) + coalesce(advance_pctile, 0) + coalesce(breadth_pctile, 0))/nullif(CAST(amount_pctile IS NOT NULL AS INT) + CAST(advance_pctile IS NOT NULL AS INT) + CAST(breadth_pctile IS NOT NULL AS INT), 0) AS state_score,
 amount_rows/universe_rows AS amount_coverage, participation_eligible/universe_rows AS participation_coverage
FROM (SELECT *, {_rk("total_amount")} AS amount_pctile, {_rk("advance_ratio")} AS advance_pctile, {_rk("breadth")} AS breadth_pctile FROM (
SELECT *, advancers/nullif(advancers + decliners, 0) AS advance_ratio, participants/nullif(participation_eligible, 0) AS breadth FROM (SELECT * REPLACE (round(total_amount, 2) AS total_amount) FROM mds)) WINDOW f AS (ORDER BY date ROWS 59 PRECEDING))""",
    "mds",
)
MSP = "amount_pctile advance_pctile breadth_pctile state_score amount_coverage participation_coverage"


def _state(spark, d):
    daily = market.market_daily_state(bars(spark, d))
    return market.market_state_percentiles(daily.selectExpr("* EXCEPT (total_amount)", "round(total_amount, 2) AS total_amount"))


def market_state_percentiles(spark, d):
    return out(_state(spark, d), f"date {MSP}")


QUERIES["market_state_percentiles"] = market_state_percentiles
ORACLES["market_state_percentiles"] = sql(f"SELECT date, {r(MSP)} FROM msp", "msp")

cte(
    "timing",
    """SELECT date, active_cap, pct_chg, coalesce(last_value(event IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 'bearish') AS state FROM (
SELECT *, CASE WHEN pct_chg <= -2.3 THEN 'bearish' WHEN pct_chg >= 4 OR pct_chg + lag(pct_chg) OVER (ORDER BY date) >= 4 THEN 'bullish' END AS event FROM (
SELECT date, active_cap, (active_cap/lag(active_cap) OVER (ORDER BY date) - 1)*100 AS pct_chg FROM market))""",
    "market",
)


def market_timing(spark, d):
    return out(market.market_timing(plan.market_series(bars(spark, d))).drop("active_cap"), "*")


QUERIES["market_timing"] = market_timing
ORACLES["market_timing"] = sql(f"SELECT date, state, {r('pct_chg')} FROM timing", "timing")


def regime_intervals(spark, d):
    return out(market.regime_intervals(market.market_timing(plan.market_series(bars(spark, d)))), "*")


QUERIES["regime_intervals"] = regime_intervals
ORACLES["regime_intervals"] = sql(
    f"""SELECT state, days, runs, {r('mean_run')} FROM (SELECT state, count(*) AS days, count(DISTINCT g) AS runs, count(*)/count(DISTINCT g) AS mean_run FROM (
SELECT *, row_number() OVER (ORDER BY date) - row_number() OVER (PARTITION BY state ORDER BY date) AS g FROM timing) GROUP BY state)""",
    "timing",
)


def regime_gates(spark, d):
    b = bars(spark, d)
    states = market.market_timing(plan.market_series(b))
    rows = market.state_on(ind.add_indicators(b), states, "date")
    rows = market.near_pct_by_regime(rows, 20.0, 5.0).selectExpr("*", "J AS score")
    return out(market.bear_override(rows, 50.0), "code date state position_ok")


QUERIES["regime_gates"] = regime_gates
ORACLES["regime_gates"] = sql(
    f"""SELECT code, date, state, {i('position_ok')} FROM (SELECT code, date, state, "J", (close >= yellow_line AND close <= white_line) OR abs(close - white_line)/white_line*100 <= CASE state WHEN 'bullish' THEN 20 ELSE 5 END AS position_ok
FROM ind JOIN timing USING (date)) WHERE state <> 'bearish' OR "J" >= 50""",
    "ind",
    "timing",
)


def state_lookup(spark, d):
    """Ship dates of the orders table looked up in the states on or before them."""
    states = market.market_timing(plan.market_series(bars(spark, d))).filter("weekofyear(date) % 3 = 0")
    orders = wh.table(spark, d, "orders").selectExpr("o_orderkey", "CAST(o_orderdate AS DATE) AS day")
    return out(market.state_on(orders, states, "day"), "o_orderkey day state")


QUERIES["state_lookup"] = state_lookup
ORACLES["state_lookup"] = sql(
    """SELECT o_orderkey, day, coalesce(state, 'bearish') AS state FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) o
ASOF LEFT JOIN (SELECT date, state FROM timing WHERE weekofyear(date) % 3 = 0) t ON o.day >= t.date""",
    "timing",
)


def volume_authenticity(spark, d):
    return out(market.volume_authenticity(bars(spark, d)), "*")


QUERIES["volume_authenticity"] = volume_authenticity
ORACLES["volume_authenticity"] = sql(
    f"""SELECT code, date, {r('stock_contraction market_volume market_contraction ratio authenticity_rank')} FROM (SELECT *, {pr('ratio', 'date', None)} AS authenticity_rank FROM (
SELECT code, date, stock_contraction, market_volume, market_contraction, stock_contraction/nullif(market_contraction, 0) AS ratio FROM (
SELECT code, date, CASE WHEN count(*) OVER {sw(20)} >= 20 THEN avg(volume) OVER {sw(5)}/avg(volume) OVER {sw(15, 5)} END AS stock_contraction FROM bars)
JOIN (SELECT date, market_volume, CASE WHEN count(*) OVER (ORDER BY date ROWS 19 PRECEDING) >= 20 THEN avg(market_volume) OVER (ORDER BY date ROWS 4 PRECEDING)/avg(market_volume) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND 5 PRECEDING) END AS market_contraction
 FROM (SELECT date, sum(volume) AS market_volume FROM bars GROUP BY date)) USING (date)) WHERE ratio IS NOT NULL)""",
    "bars",
)

LIB_PLAIN = " ".join(pools.LIBRARY)


def factor_library(spark, d):
    return out(pools.factor_library(bars(spark, d)), f"code date {LIB_PLAIN} high_streak low_streak max_streak")


def _streak(cond: str) -> str:
    return f"rn - coalesce(max(CASE WHEN {cond} THEN NULL ELSE rn END) OVER (PARTITION BY code ORDER BY rn), 0)"


def _mp(expr: str, of: str, n: int, k: int) -> str:
    return f"CASE WHEN count({of}) OVER {sw(n)} >= {k} THEN {expr} END"


cte(
    "lib",
    f"""SELECT *, 1/(1 + volume_to_median)*support_score AS conditional_shrink, 1/(1 + trough_depth*10)*(1/(1 + trough_volume)) AS w_absorption, turnover_ratio*amplitude AS turnover_x_amplitude
FROM (SELECT *, CASE WHEN rng IS NOT NULL THEN greatest(0, least(1, 1 - abs((high - greatest(open, close)) - (least(open, close) - low))/rng)) END AS shadow_symmetry,
 CASE WHEN rng IS NOT NULL THEN greatest(0, least(1, (close - low)/rng)) END AS range_position, volume/vmed AS volume_to_median,
 CASE WHEN h20 > l20 THEN greatest(0, least(1, 1 - (close - l20)/(h20 - l20))) END AS support_score,
 CASE WHEN len(dl) >= 20 AND dd IS NOT NULL THEN (len(list_filter(dl, lambda x: x < dd)) + (len(list_filter(dl, lambda x: x = dd)) + 1)/2.0)/len(dl) END AS pullback_percentile,
 CASE WHEN n20 >= 5 THEN 1/(1 + stddev_pop(volume) OVER {sw(20)}/avg(volume) OVER {sw(20)}) END AS volume_equilibrium,
 CASE WHEN abs_ret > 0 AND lag(close, 10) OVER {S} IS NOT NULL THEN greatest(0, least(1, abs(close/lag(close, 10) OVER {S} - 1)/abs_ret)) END AS path_efficiency,
 CASE WHEN n_ret >= 5 THEN abs(sum(sign(ret)) OVER {sw(10)})/n_ret END AS path_consistency,
 -((h10 - l10)/close) AS range_width_10, -((h20 - l20)/close) AS range_width_20, -((h40 - l40)/close) AS range_width_40,
 ((h60 - l60)/close - (h20 - l20)/close)/nullif((h60 - l60)/close, 0) AS range_narrowing,
 CASE WHEN sign(close - lag(close, 3) OVER {S}) = sign(close - lag(close, 10) OVER {S}) THEN 0.0 ELSE 1.0 END AS direction_flip,
 CASE WHEN l20 IS NOT NULL THEN greatest((close - l20)/close, 0) END AS trough_depth, CASE WHEN n20 >= 5 THEN min(volume) OVER {sw(20)} END/vmed AS trough_volume,
 {", ".join(_mp(f"stddev_pop(least(ret, 0)) FILTER (ret IS NOT NULL) OVER {sw(n)}", "ret", n, max(3, n // 2)) + f"/({_mp(f'stddev_pop(greatest(ret, 0)) FILTER (ret IS NOT NULL) OVER {sw(n)}', 'ret', n, max(3, n // 2))} + 1e-9) AS downside_skew_{n}" for n in (5, 10, 20, 40))},
 1/(1 + {_mp(f"avg(abs(vchg)) OVER {sw(10)}", "vchg", 10, 5)}) AS volume_smooth_10, 1/(1 + {_mp(f"avg(abs(vchg)) OVER {sw(20)}", "vchg", 20, 8)}) AS volume_smooth_20,
 CASE WHEN count(vl) OVER {sw(10)} >= 6 THEN CASE WHEN abs(corr(vchg, vl) OVER {sw(10)}) <= 1.1 THEN corr(vchg, vl) OVER {sw(10)} END END AS volume_autocorr,
 max(hs) OVER {sw(20)} AS high_streak, max(ls) OVER {sw(20)} AS low_streak, greatest(max(cu) OVER {sw(20)}, max(cd) OVER {sw(20)}) AS max_streak,
 turnover/100 AS ff_turnover, greatest(0, least(2, (volume/(turnover/100))/(market_cap/(amount/volume)))) AS free_float_ratio,
 (turnover/100)/CASE WHEN n20 >= 5 THEN avg(turnover/100) OVER {sw(20)} END AS turnover_ratio, abs((high - low)/pc) AS amplitude
FROM (SELECT *, greatest(1 - close/h20, 0) AS dd, list(greatest(1 - close/h20, 0)) FILTER (h20 IS NOT NULL) OVER {sw(120)} AS dl, {_mp(f"sum(abs(ret)) OVER {sw(10)}", "ret", 10, 5)} AS abs_ret, count(ret) OVER {sw(10)} AS n_ret, lag(vchg) OVER {S} AS vl,
  {_streak("high > lh")} AS hs, {_streak("low < ll")} AS ls, {_streak("close > pc")} AS cu, {_streak("close < pc")} AS cd
 FROM (SELECT *, close/pc - 1 AS ret, volume/pv - 1 AS vchg, count(*) OVER {sw(20)} AS n20, CASE WHEN count(*) OVER {sw(20)} >= 5 THEN median(volume) OVER {sw(20)} END AS vmed,
  {", ".join(f"CASE WHEN count(*) OVER {sw(n)} >= {k} THEN max(high) OVER {sw(n)} END AS h{n}, CASE WHEN count(*) OVER {sw(n)} >= {k} THEN min(low) OVER {sw(n)} END AS l{n}" for n, k in ((10, 5), (20, 5), (40, 10), (60, 15)))},
  CASE WHEN high > low THEN high - low END AS rng
  FROM (SELECT *, row_number() OVER {S} AS rn, lag(close) OVER {S} AS pc, lag(volume) OVER {S} AS pv, lag(high) OVER {S} AS lh, lag(low) OVER {S} AS ll FROM bars))))""",
    "bars",
)
QUERIES["factor_library"] = factor_library
ORACLES["factor_library"] = sql(f"SELECT code, date, {r(LIB_PLAIN)}, {i('high_streak low_streak max_streak')} FROM lib", "lib")


def _signals(spark, d):
    """Labelled signals with entry features and the library columns of their signal row."""
    from tapeloom.operators import outcomes

    b = bars(spark, d)
    t = outcomes.label_trades(brick.entry_features(plan.rows(b))).filter("status <> 'blocked'")
    lib = pools.factor_library(b).selectExpr("code", "date AS signal_date", "pullback_percentile", "shadow_symmetry", "range_position", "downside_skew_20")
    return t.join(lib, ["code", "signal_date"])


cte(
    "sig",
    f"""SELECT t.*, e.overnight_gap_pct, e.entry_open_to_yellow_pct, e.entry_open_to_ma5_pct, l.pullback_percentile, l.shadow_symmetry, l.range_position, l.downside_skew_20 FROM trades t
JOIN lib l ON l.code = t.code AND l.date = t.signal_date JOIN (SELECT code, date, (eo - close)/close*100 AS overnight_gap_pct, (eo - y)/y*100 AS entry_open_to_yellow_pct, (eo - m)/m*100 AS entry_open_to_ma5_pct
FROM (SELECT *, coalesce(ly, yellow_line) + (eo - coalesce(lc, close))*(1/14.0 + 1/28.0 + 1/57.0 + 1/114.0)/4 AS y, coalesce(lm, ma5) + (eo - coalesce(lc, close))/5 AS m
FROM (SELECT *, coalesce(lead(open) OVER {S}, open) AS eo, lead(close) OVER {S} AS lc, lead(yellow_line) OVER {S} AS ly, lead(ma5) OVER {S} AS lm FROM bricks))) e ON e.code = t.code AND e.date = t.signal_date
WHERE status <> 'blocked'""",
    "trades",
    "lib",
)


def peer_relative(spark, d):
    return out(pools.pool_size_bucket(pools.peer_relative(_signals(spark, d))), "code signal_date peer_pool_size volume_contraction_rank turnover_rank ma_distance_rank pool_size_bucket")


def _desc(x, by):
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x} DESC) + (count(*) OVER (PARTITION BY {by}, {x}) - 1)/2.0)/count(*) OVER (PARTITION BY {by})"


cte(
    "peers",
    f"""SELECT *, CASE WHEN peer_pool_size <= (SELECT quantile_cont(s, 1/3.0) FROM (SELECT signal_date, count(*) AS s FROM sig GROUP BY 1)) THEN 'small'
 WHEN peer_pool_size <= (SELECT quantile_cont(s, 2/3.0) FROM (SELECT signal_date, count(*) AS s FROM sig GROUP BY 1)) THEN 'medium' ELSE 'large' END AS pool_size_bucket
FROM (SELECT *, count(*) OVER (PARTITION BY signal_date) AS peer_pool_size, {_desc('vol_ratio_20', 'signal_date')} AS volume_contraction_rank, {pr('turnover_ratio_20', 'signal_date')} AS turnover_rank, {pr('abs(close_to_ma20_pct)', 'signal_date')} AS ma_distance_rank FROM sig)""",
    "sig",
)
QUERIES["peer_relative"] = peer_relative
ORACLES["peer_relative"] = sql(f"SELECT code, signal_date, peer_pool_size, pool_size_bucket, {r('volume_contraction_rank turnover_rank ma_distance_rank')} FROM peers", "peers")

RAW = "raw_volume_trend raw_path_return raw_rsi raw_high_distance raw_turnover_trend"
cte(
    "secraw",
    f"""SELECT code, date, CASE WHEN count(*) OVER {sw(20)} >= 20 THEN avg(volume) OVER {sw(5)}/avg(volume) OVER {sw(20)} END AS raw_volume_trend, close/lag(close, 9) OVER {S} - 1 AS raw_path_return,
 CASE WHEN count(pc) OVER {sw(14)} < 14 THEN NULL WHEN sum(loss) OVER {sw(14)} = 0 AND sum(gain) OVER {sw(14)} > 0 THEN 100 WHEN sum(loss) OVER {sw(14)} = 0 THEN 50 ELSE 100 - 100/(1 + sum(gain) OVER {sw(14)}/sum(loss) OVER {sw(14)}) END AS raw_rsi,
 CASE WHEN count(*) OVER {sw(20)} >= 20 THEN close/max(high) OVER {sw(20)} - 1 END AS raw_high_distance, CASE WHEN count(*) OVER {sw(30)} >= 30 THEN avg(turnover) OVER {sw(10)}/avg(turnover) OVER {sw(30)} END AS raw_turnover_trend FROM rsv""",
    "rsv",
)
cte(
    "assign",
    """SELECT * FROM (SELECT code, block, block_size, row_number() OVER (PARTITION BY code ORDER BY block) AS block_order FROM membership JOIN (SELECT block, count(*) AS block_size FROM membership GROUP BY block) USING (block) WHERE block_size BETWEEN 2 AND 1000000) WHERE block_order <= 3""",
    "membership",
)


def sector_raw_metrics(spark, d):
    return out(pools.sector_raw_metrics(bars(spark, d)), "*")


QUERIES["sector_raw_metrics"] = sector_raw_metrics
ORACLES["sector_raw_metrics"] = sql(f"SELECT code, date, {r(RAW)} FROM secraw", "secraw")


def sector_assignments(spark, d):
    return out(pools.sector_assignments(wh.membership(spark, d), 2, 1000000, 3), "*")


QUERIES["sector_assignments"] = sector_assignments
ORACLES["sector_assignments"] = sql("SELECT code, block, block_size, CAST(block_order AS INT) AS block_order FROM assign", "assign")
SEC = " ".join(pools.SECTOR_RANKS) + " sector_composite"


def sector_relative(spark, d):
    a = pools.sector_assignments(wh.membership(spark, d), 2, 1000000, 3)
    m = pools.sector_raw_metrics(bars(spark, d)).selectExpr("code", "date", *[f"round({x}, 10) AS {x}" for x in RAW.split()])
    return out(pools.sector_relative(m, a), f"code date {SEC} block_count group_size_min group_size_median group_size_max")


def _sr(raw, inv):
    v = pr(raw, "date, block", None)
    return f"CASE WHEN count({raw}) OVER g >= 3 THEN coalesce({'1 - ' if inv else ''}({v}), 0.5) ELSE 0.5 END"


QUERIES["sector_relative"] = sector_relative
ORACLES["sector_relative"] = sql(
    f"""SELECT code, date, {r(SEC)}, block_count, group_size_min, round(CAST(group_size_median AS DOUBLE), 6) AS group_size_median, group_size_max FROM (
SELECT code, date, {", ".join(f"avg({n}) AS {n}" for n in pools.SECTOR_RANKS)}, avg(comp) AS sector_composite, count(DISTINCT block) AS block_count, min(gs) AS group_size_min, median(gs) AS group_size_median, max(gs) AS group_size_max
FROM (SELECT *, ({" + ".join(f"CASE WHEN stddev_samp({n}) OVER g > 1e-12 THEN ({n} - avg({n}) OVER g)/stddev_samp({n}) OVER g ELSE 0 END" for n in pools.SECTOR_RANKS)})/5 AS comp FROM (
SELECT *, count(*) OVER g AS gs, {", ".join(f"{_sr(raw, inv)} AS {n}" for n, (raw, inv) in pools.SECTOR_RANKS.items())} FROM (
SELECT m.code, m.date, coalesce(a.block, 'UNKNOWN') AS block, {", ".join(f"round({x}, 10) AS {x}" for x in RAW.split())} FROM secraw m LEFT JOIN assign a USING (code)) WINDOW g AS (PARTITION BY date, block)) WINDOW g AS (PARTITION BY date, block))
GROUP BY code, date)""",
    "secraw",
    "assign",
)

cte(
    "pool",
    """SELECT signal_date, min(entry_date) AS entry_date, count(*) AS pool_size, avg(CASE WHEN overnight_gap_pct <= 0 AND entry_open_to_ma5_pct BETWEEN -5 AND 2 THEN 1.0 ELSE 0.0 END) AS coherence, stddev_pop(overnight_gap_pct) AS gap_std,
 avg(CASE WHEN entry_open_to_yellow_pct <= 0 THEN 1.0 ELSE 0.0 END) AS support, avg(overnight_gap_pct) AS mean_gap FROM sig GROUP BY signal_date""",
    "sig",
)


def pool_panel(spark, d):
    return out(pools.pool_panel(_signals(spark, d)), "*")


QUERIES["pool_panel"] = pool_panel
ORACLES["pool_panel"] = sql(f"SELECT signal_date, entry_date, pool_size, {r('coherence gap_std support mean_gap')} FROM pool", "pool")
TRAIN = ("1996-01-01", "1998-12-31")
cte(
    "pq",
    f"""SELECT *, (SELECT median(pool_quality) FROM pq0 WHERE entry_date BETWEEN DATE '{TRAIN[0]}' AND DATE '{TRAIN[1]}') AS threshold FROM pq0""",
    "pq0",
)
cte(
    "pq0",
    f"""SELECT *, (c + 1 - dd + y)/3 AS pool_quality FROM (SELECT p.*, {", ".join(f"(SELECT avg(CASE WHEN t.{v} <= p.{v} THEN 1.0 ELSE 0.0 END) FROM pqt t WHERE t.entry_date BETWEEN DATE '{TRAIN[0]}' AND DATE '{TRAIN[1]}') AS {n}" for v, n in (("coherence", "c"), ("gap_std", "dd"), ("yellow_low", "y")))} FROM pqt p)""",
    "pqt",
)
cte(
    "pqt",
    f"""SELECT * REPLACE (round(coherence, 10) AS coherence, round(gap_std, 8) AS gap_std), CASE WHEN support <= (SELECT quantile_cont(support, 0.25) FROM pool WHERE entry_date BETWEEN DATE '{TRAIN[0]}' AND DATE '{TRAIN[1]}') THEN 1.0 ELSE 0.0 END AS yellow_low FROM pool""",
    "pool",
)


def _quality(signals):
    p = pools.pool_panel(signals).selectExpr("* EXCEPT (coherence, gap_std)", "round(coherence, 10) AS coherence", "round(gap_std, 8) AS gap_std")
    return pools.pool_quality(p, *TRAIN)


def pool_quality(spark, d):
    return out(_quality(_signals(spark, d)), "signal_date yellow_low pool_quality threshold")


QUERIES["pool_quality"] = pool_quality
ORACLES["pool_quality"] = sql(f"SELECT signal_date, {r('yellow_low pool_quality threshold')} FROM pq", "pq")


def dynamic_top_k(spark, d):
    # The signals are stored: scores and pools both read them.
    t = cut_lineage(_signals(spark, d))
    s = scoring.dimension_score(t)
    q = _quality(t).selectExpr("* EXCEPT (pool_quality, threshold)", "round(pool_quality, 9) AS pool_quality", "round(threshold, 9) AS threshold")
    return out(pools.dynamic_top_k(scoring.pick(s, 5), q), "code signal_date rank selected_k")


QUERIES["dynamic_top_k"] = dynamic_top_k
ORACLES["dynamic_top_k"] = sql(
    """SELECT code, signal_date, CAST(rank AS INT) AS rank, CAST(k AS INT) AS selected_k FROM (SELECT s.code, s.signal_date, rank, CASE WHEN round(pool_quality, 9) >= round(threshold, 9) AND pool_size >= 5 THEN 5 ELSE 3 END AS k
FROM (SELECT *, row_number() OVER (PARTITION BY entry_date ORDER BY round(score, 12) DESC, code) AS rank FROM scored) s LEFT JOIN pq USING (signal_date) WHERE rank <= 5) WHERE rank <= k""",
    "scored",
    "pq",
)

PF = "sentiment_median regime_label sentiment_x_pullback symmetry_x_gap position_x_gap pullback_peer_rank downside_skew_residual"
cte(
    "pf",
    f"""SELECT *, CASE WHEN sentiment_median > 2 THEN 1.0 WHEN sentiment_median < -2 THEN -1.0 ELSE 0.0 END AS regime_label, coalesce(sentiment_median, 0)*coalesce(pullback_percentile, 0.5) AS sentiment_x_pullback,
 coalesce(shadow_symmetry, 0.5)*-abs(overnight_gap_pct) AS symmetry_x_gap, coalesce(range_position, 0.5)*overnight_gap_pct AS position_x_gap, {pr('pullback_percentile', 'signal_date')} AS pullback_peer_rank,
 downside_skew_20 - median(downside_skew_20) OVER (PARTITION BY signal_date) AS downside_skew_residual
FROM (SELECT *, count(*) OVER (PARTITION BY signal_date) AS peer_signal_count, median(ret_5d) OVER (PARTITION BY signal_date) AS sentiment_median FROM (SELECT * REPLACE (round(pullback_percentile, 10) AS pullback_percentile) FROM sig))""",
    "sig",
)


def _pool_features(spark, d):
    s = _signals(spark, d).selectExpr("* EXCEPT (pullback_percentile)", "round(pullback_percentile, 10) AS pullback_percentile")
    return pools.pool_features(s)


def pool_features(spark, d):
    return out(_pool_features(spark, d), f"code signal_date peer_signal_count {PF}")


QUERIES["pool_features"] = pool_features
ORACLES["pool_features"] = sql(f"SELECT code, signal_date, peer_signal_count, {r(PF)} FROM pf", "pf")

cte(
    "dst",
    """SELECT entry_date, count(*) AS n_candidates, coalesce(stddev_pop(score) FILTER (rk <= 100), 0) AS dispersion, coalesce(max(score) FILTER (rk = 3) - max(score) FILTER (rk = 10), 0) AS gap_3_10,
 coalesce(avg(return_pct) FILTER (rk <= 3), 0) AS top3_return, coalesce(avg(return_pct) FILTER (rk BETWEEN 4 AND 10), 0) AS rank4_10_return, min(regime_label) FILTER (c = mc) AS regime_label
FROM (SELECT *, max(c) OVER (PARTITION BY entry_date) AS mc FROM (SELECT s.entry_date, s.score, s.return_pct, p.regime_label, row_number() OVER (PARTITION BY s.entry_date ORDER BY round(s.score, 12) DESC, s.code) AS rk, count(*) OVER (PARTITION BY s.entry_date, p.regime_label) AS c
FROM scored s JOIN pf p ON p.code = s.code AND p.signal_date = s.signal_date)) GROUP BY entry_date""",
    "scored",
    "pf",
)


def _day_stats(spark, d):
    return pools.day_stats(scoring.dimension_score(_pool_features(spark, d)))


def day_stats(spark, d):
    return out(_day_stats(spark, d), "*")


QUERIES["day_stats"] = day_stats
ORACLES["day_stats"] = sql(f"SELECT entry_date, n_candidates, {r('dispersion gap_3_10 top3_return rank4_10_return regime_label')} FROM dst", "dst")


def abstention_thresholds(spark, d):
    s = _day_stats(spark, d).selectExpr("* EXCEPT (dispersion)", "round(dispersion, 9) AS dispersion")
    return out(pools.abstention_thresholds(s), "*")


QUERIES["abstention_thresholds"] = abstention_thresholds
ORACLES["abstention_thresholds"] = sql(
    f"""SELECT CAST(regime_label AS DOUBLE) AS regime_label, {r('threshold pass_rate margin')}, days, kept_days, CAST(gate AS INT) AS gate FROM (SELECT *, kept_days/days >= 0.5 AND margin >= 0 AS gate FROM (SELECT *, kept_days/days AS pass_rate, top3 - rest AS margin FROM (
SELECT g.regime_label, g.threshold, count(*) AS days, count(*) FILTER (g.threshold IS NULL OR d.dispersion >= g.threshold) AS kept_days, coalesce(avg(top3_return) FILTER (g.threshold IS NULL OR d.dispersion >= g.threshold), -999) AS top3,
 coalesce(avg(rank4_10_return) FILTER (g.threshold IS NULL OR d.dispersion >= g.threshold), 999) AS rest
FROM (SELECT DISTINCT regime_label, UNNEST(list_concat([NULL], list_transform(quantile_cont(round(dispersion, 9), [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]), lambda x: round(x, 12)))) AS threshold FROM dst GROUP BY regime_label) g
JOIN (SELECT * REPLACE (round(dispersion, 9) AS dispersion) FROM dst) d ON d.regime_label = g.regime_label GROUP BY ALL)))
QUALIFY row_number() OVER (PARTITION BY regime_label ORDER BY gate DESC, round(margin, 8) DESC, round(top3, 8) DESC, round(pass_rate, 8) DESC, coalesce(threshold, -1)) = 1""",
    "dst",
)


def state_modulation(spark, d):
    s = _state(spark, d).selectExpr("date", "state_score")
    m = pools.sector_raw_metrics(bars(spark, d)).join(s, "date", "left")
    return out(pools.state_modulation(m, ["raw_volume_trend", "raw_turnover_trend"]), "code date state_score raw_volume_trend_x_state raw_turnover_trend_x_state")


QUERIES["state_modulation"] = state_modulation
ORACLES["state_modulation"] = sql(
    f"SELECT code, date, {r('state_score raw_volume_trend_x_state raw_turnover_trend_x_state')} FROM (SELECT code, date, state_score, raw_volume_trend*state_score AS raw_volume_trend_x_state, raw_turnover_trend*state_score AS raw_turnover_trend_x_state FROM secraw LEFT JOIN msp USING (date))",
    "secraw",
    "msp",
)
