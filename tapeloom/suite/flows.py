"""Fund flows and large prints."""

from __future__ import annotations

from tapeloom.operators import flows as fl
from tapeloom.sources import warehouse as wh
from tapeloom.suite.common import bars, out
from tapeloom.suite.sqlbase import S, cte, i, r, sql

QUERIES, ORACLES = {}, {}


def deal_directions(spark, d):
    from tapeloom.functions.scalars import normalize_direction

    deals = wh.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CASE l_returnflag WHEN 'R' THEN '卖盘' WHEN 'A' THEN '买盘' END AS side")
    return deals.selectExpr("l_orderkey", "l_linenumber", f"{normalize_direction('side')} AS direction").groupBy("l_orderkey", "direction").count()


QUERIES["deal_directions"] = deal_directions
ORACLES["deal_directions"] = "SELECT l_orderkey, CASE WHEN l_returnflag = 'A' THEN 'buy' ELSE 'sell' END AS direction, count(*) AS count FROM lineitem GROUP BY ALL"

cte(
    "mflow",
    """SELECT lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(6, length(CAST(l_suppkey AS VARCHAR))) AS INT), '0') AS code, CAST(wk AS DATE) AS date, inflow, outflow, inflow - outflow AS net_flow, amount, v*100/(1000.0*(1 + l_suppkey % 7)) AS turnover FROM (
SELECT l_suppkey, date_trunc('week', l_shipdate) AS wk, coalesce(sum(c) FILTER (l_returnflag = 'N'), 0)/100.0 AS inflow, coalesce(sum(c) FILTER (l_returnflag = 'R'), 0)/100.0 AS outflow, sum(c)/100.0 AS amount, sum(l_quantity) AS v
FROM (SELECT *, CAST(round(l_extendedprice*100) AS BIGINT) AS c FROM lineitem) GROUP BY ALL)""",
)
cte(
    "cflow",
    """SELECT block AS concept, date, sum(inflow) AS inflow, sum(outflow) AS outflow, sum(net_flow) AS net_flow, coalesce(sum(net_flow)/nullif(sum(amount), 0)*100, 0) AS change_pct FROM mflow JOIN membership USING (code) GROUP BY ALL""",
    "mflow",
    "membership",
)
cte("deals", """SELECT lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(6, length(CAST(l_suppkey AS VARCHAR))) AS INT), '0') AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice/l_quantity AS price, l_extendedprice AS amount, CASE l_returnflag WHEN 'A' THEN 'buy' WHEN 'R' THEN 'sell' ELSE '' END AS direction FROM lineitem""")


def _pk(x):
    return f"((rank() OVER (ORDER BY round({x}, 8)) + (count(*) OVER (PARTITION BY round({x}, 8)) - 1)/2.0)/count(*) OVER ())"


cte(
    "strength",
    f"""SELECT *, {_pk('total_net')}*35 + {_pk('net_efficiency')}*25 + {_pk('avg_change')}*20 + {_pk('win_rate')}*20 AS strength_score FROM (SELECT concept, count(*) AS days, sum(net_flow) AS total_net, avg(CASE WHEN net_flow > 0 THEN 1.0 ELSE 0 END) AS win_rate,
 CASE WHEN count(*) >= 3 THEN coalesce(regr_slope(net_flow, i), 0) ELSE 0 END AS trend_slope, avg(change_pct) AS avg_change, coalesce(sum(net_flow)/nullif(sum(inflow) + sum(outflow), 0)*100, 0) AS net_efficiency
FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY date) AS i FROM cflow WHERE date >= (SELECT min(date) FROM (SELECT DISTINCT date FROM cflow ORDER BY date DESC LIMIT 40))) GROUP BY concept)""",
    "cflow",
)


def _strength(spark, d):
    return fl.concept_strength(fl.concept_flow(wh.money_flow(spark, d), wh.membership(spark, d)), 40)


STR = "total_net win_rate trend_slope avg_change net_efficiency strength_score"


def concept_strength(spark, d):
    return out(_strength(spark, d), "*")


QUERIES["concept_strength"] = concept_strength
ORACLES["concept_strength"] = sql(f"SELECT concept, days, {r(STR)} FROM strength", "strength")


def concept_alignment(spark, d):
    return out(fl.concept_alignment(_strength(spark, d), wh.membership(spark, d), 12), "*")


QUERIES["concept_alignment"] = concept_alignment
ORACLES["concept_alignment"] = sql(
    f"""SELECT code, total_concepts, matched_concepts, {r('score')}, CAST(matched_concepts > 0 AS INT) AS in_mainline FROM (SELECT code, count(*) AS total_concepts, count(concept) AS matched_concepts, count(concept)*100.0/count(*) AS score FROM membership LEFT JOIN (SELECT concept FROM strength ORDER BY round(strength_score, 8) DESC, concept LIMIT 12) ON concept = block GROUP BY code)""",
    "strength",
    "membership",
)
cte(
    "reluct",
    """SELECT code, n, net_slope, out_slope, turn_slope, ratio_slope, up/(n - 1) AS consistency, greatest(0, least(100, 50 + CASE WHEN ao > 0 THEN least(25, greatest(-25, -out_slope/(ao/n)*25)) ELSE 0 END + CASE WHEN an > 0 THEN least(15, greatest(-15, net_slope/(an/n)*15)) ELSE 0 END + up/(n - 1)*10
 + CASE WHEN atv > 0 THEN least(10, greatest(-10, -turn_slope/(atv/n)*10)) ELSE 0 END)) AS reluctance_score, CASE WHEN net_slope > 0.05 THEN 'shrinking' WHEN net_slope < -0.05 THEN 'expanding' ELSE 'flat' END AS trend FROM (
SELECT code, count(*) AS n, regr_slope(net_flow, i) AS net_slope, regr_slope(outflow, i) AS out_slope, regr_slope(turnover, i) AS turn_slope, regr_slope(ratio, i) AS ratio_slope, count(*) FILTER (net_flow > p) AS up, avg(abs(outflow)) AS ao, avg(abs(net_flow)) AS an, avg(turnover) AS atv
FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS i, lag(net_flow) OVER (PARTITION BY code ORDER BY date) AS p, coalesce(net_flow/nullif(inflow + outflow, 0), 0) AS ratio FROM mflow WHERE date >= (SELECT min(date) FROM (SELECT DISTINCT date FROM mflow ORDER BY date DESC LIMIT 40))) GROUP BY code HAVING count(*) >= 3)""",
    "mflow",
)
REL = "net_slope out_slope turn_slope ratio_slope consistency reluctance_score"


def holding_reluctance(spark, d):
    return out(fl.holding_reluctance(wh.money_flow(spark, d), 40), "*")


QUERIES["holding_reluctance"] = holding_reluctance
ORACLES["holding_reluctance"] = sql(f"SELECT code, n, {r(REL)}, trend FROM reluct", "reluct")


def reluctance_top(spark, d):
    return out(fl.reluctance_top(wh.money_flow(spark, d), 40, 5), "code reluctance_score trend")


QUERIES["reluctance_top"] = reluctance_top
ORACLES["reluctance_top"] = sql(f"SELECT code, {r('reluctance_score')}, trend FROM (SELECT * FROM reluct ORDER BY round(reluctance_score, 8) DESC, code LIMIT 5)", "reluct")


def big_deal_threshold(spark, d):
    return out(fl.big_deal_threshold(wh.big_deals(spark, d)), "*")


QUERIES["big_deal_threshold"] = big_deal_threshold
ORACLES["big_deal_threshold"] = sql(f"SELECT code, {r('threshold')} FROM (SELECT code, CASE WHEN count(*) >= 10 THEN quantile_cont(amount, 0.85) ELSE 0 END AS threshold FROM deals GROUP BY code)", "deals")

cte(
    "located",
    """SELECT d.*, t.threshold, CASE WHEN price > greatest(open, close) THEN 'upper_wick' WHEN price < least(open, close) THEN 'lower_wick' ELSE 'body' END AS position, CASE WHEN close > open THEN 'bullish' WHEN close < open THEN 'bearish' ELSE 'flat' END AS candle
FROM deals d JOIN (SELECT code, quantile_cont(amount, 0.85) AS threshold FROM deals GROUP BY code HAVING count(*) >= 20) t ON t.code = d.code AND d.amount >= t.threshold JOIN bars b ON b.code = d.code AND b.date = d.date""",
    "deals",
    "bars",
)
_pat = ", ".join(
    f"count(*) FILTER (direction = '{d}' AND candle = '{c}' AND position = '{p}') AS {n}_n, coalesce(sum(amount) FILTER (direction = '{d}' AND candle = '{c}' AND position = '{p}'), 0) AS {n}_amt"
    for n, (d, c, p) in fl.PATTERNS.items()
)
cte(
    "patterns",
    f"""SELECT *, greatest(0, least(100, 50 + CASE WHEN buy_in_bear_wick_n > 0 THEN least(30, buy_in_bear_wick_amt/al*200) ELSE 0 END + CASE WHEN buy_ratio > 50 THEN least(15, (buy_ratio - 50)*0.5) ELSE 0 END - CASE WHEN sell_in_bear_body_n > 0 AND buy_in_bear_wick_n = 0 THEN 10 ELSE 0 END
 + CASE WHEN buy_in_bull_body_n > 0 THEN least(10, buy_in_bull_body_amt/al*100) ELSE 0 END - CASE WHEN sell_in_bull_wick_n > 0 THEN least(10, sell_in_bull_wick_amt/al*100) ELSE 0 END)) AS absorption_score, coalesce(m - CASE WHEN nb > 1 THEN s ELSE m*0.01 END, 0) AS buy_zone_low, coalesce(m + CASE WHEN nb > 1 THEN s ELSE m*0.01 END, 0) AS buy_zone_high,
 CASE WHEN buy_ratio >= 50 THEN 'buy' ELSE 'sell' END AS dominant_direction FROM (SELECT *, coalesce(total_buy/nullif(total_buy + total_sell, 0)*100, 50) AS buy_ratio, greatest(total_buy + total_sell, 1) AS al FROM (
SELECT code, count(*) AS total_big_deals, max(threshold) AS threshold, coalesce(sum(amount) FILTER (direction = 'buy'), 0) AS total_buy, coalesce(sum(amount) FILTER (direction = 'sell'), 0) AS total_sell, avg(price) FILTER (direction = 'buy') AS m, stddev_pop(price) FILTER (direction = 'buy') AS s, count(*) FILTER (direction = 'buy') AS nb, {_pat} FROM located GROUP BY code HAVING count(*) >= 10))""",
    "located",
)
PAT_N = " ".join(f"{n}_n" for n in fl.PATTERNS)
PAT_F = "threshold total_buy total_sell buy_ratio " + " ".join(f"{n}_amt" for n in fl.PATTERNS) + " absorption_score buy_zone_low buy_zone_high"


def big_deal_patterns(spark, d):
    return out(fl.big_deal_patterns(wh.big_deals(spark, d), bars(spark, d)), "*")


QUERIES["big_deal_patterns"] = big_deal_patterns
ORACLES["big_deal_patterns"] = sql(f"SELECT code, total_big_deals, {PAT_N.replace(' ', ', ')}, {r(PAT_F)}, dominant_direction FROM patterns", "patterns")


def washout_quality(spark, d):
    b = bars(spark, d)
    return out(fl.washout_quality(fl.big_deal_patterns(wh.big_deals(spark, d), b), b), "code absorption_score has_absorption price_in_zone washout_quality")


QUERIES["washout_quality"] = washout_quality
ORACLES["washout_quality"] = sql(
    f"""SELECT code, {r('absorption_score')}, {i('has_absorption price_in_zone')}, CASE WHEN has_absorption AND price_in_zone AND absorption_score >= 70 THEN 'excellent' WHEN has_absorption AND absorption_score >= 60 THEN 'good' WHEN absorption_score >= 50 THEN 'neutral' ELSE 'distribution_likely' END AS washout_quality
FROM (SELECT p.*, buy_in_bear_wick_n > 0 AS has_absorption, buy_zone_low > 0 AND c BETWEEN buy_zone_low AND buy_zone_high AS price_in_zone FROM patterns p JOIN (SELECT code, arg_max(close, date) AS c FROM bars GROUP BY code) USING (code))""",
    "patterns",
    "bars",
)


def concept_index(spark, d):
    return out(fl.concept_index(bars(spark, d), wh.membership(spark, d)), "*")


QUERIES["concept_index"] = concept_index
ORACLES["concept_index"] = sql(
    f"""SELECT block, date, members, present, {r('index_return')} FROM (SELECT m.block, x.date, any_value(s.members) AS members, count(x.ret) AS present, coalesce(sum(x.ret), 0)/any_value(s.members) AS index_return FROM (SELECT code, date, close/lag(close) OVER {S} - 1 AS ret FROM bars) x JOIN membership m USING (code)
JOIN (SELECT block, count(*) AS members FROM membership GROUP BY block HAVING count(*) >= 3) s USING (block) GROUP BY m.block, x.date)""",
    "bars",
    "membership",
)
