"""Ticks and order books in batch."""

from __future__ import annotations

from tapeloom.operators import ticks as tk
from tapeloom.sources import warehouse as wh
from tapeloom.suite.common import out
from tapeloom.suite.sqlbase import cte, i, r, sql

QUERIES, ORACLES = {}, {}

CODE, DATE = ("code",), ("date",)
BY_DAY = "date"  # block of a whole-history group
LIMITS = {"retail": 50, "small": 100, "medium": 200, "large": 400}

cte(
    "ticks",
    """SELECT ts AS time, CAST(ts AS DATE) AS date, lpad(CAST(user_id AS VARCHAR), CAST(greatest(6, length(CAST(user_id AS VARCHAR))) AS INT), '0') AS code, value AS price, CAST(event_id % 10 + 1 AS DOUBLE) AS volume,
 value*(event_id % 10 + 1) AS amount, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS direction, event_id AS seq FROM events""",
)
cte(
    "book",
    """SELECT code, date, time, seq, UNNEST(range(1, 11)) AS level, price - UNNEST(range(1, 11))*0.01 AS bid_price, price + UNNEST(range(1, 11))*0.01 AS ask_price,
 CAST(((seq + UNNEST(range(1, 11))*7) % 13)*10 + CASE WHEN (seq + UNNEST(range(1, 11))) % 11 = 0 THEN 300 ELSE 1 END AS DOUBLE) AS bid_volume,
 CAST(((seq + UNNEST(range(1, 11))*5) % 17)*10 + CASE WHEN (seq + UNNEST(range(1, 11))) % 19 = 0 THEN 400 ELSE 1 END AS DOUBLE) AS ask_volume FROM ticks""",
    "ticks",
)


def size_classes(spark, d):
    return out(tk.classify_size(wh.ticks(spark, d), LIMITS), "code seq amount order_class")


QUERIES["size_classes"] = size_classes
ORACLES["size_classes"] = sql(
    f"SELECT code, seq, {r('amount')}, CASE WHEN amount < 50 THEN 'retail' WHEN amount < 100 THEN 'small' WHEN amount < 200 THEN 'medium' WHEN amount < 400 THEN 'large' ELSE 'huge' END AS order_class FROM ticks",
    "ticks",
)

cte(
    "bigs",
    """SELECT t.*, amount >= big_limit AS is_big_order, amount >= huge_limit AS is_huge_order, big_limit FROM ticks t JOIN (
SELECT code, CASE WHEN count(*) > 10 THEN quantile_cont(amount, 0.85) ELSE 100 END AS big_limit, CASE WHEN count(*) > 10 THEN quantile_cont(amount, 0.97) ELSE 500 END AS huge_limit FROM ticks GROUP BY code) USING (code)""",
    "ticks",
)


def big_orders(spark, d):
    return out(tk.flag_big_orders(wh.ticks(spark, d), CODE, fixed=100), "code seq big_limit is_big_order is_huge_order")


QUERIES["big_orders"] = big_orders
ORACLES["big_orders"] = sql(f"SELECT code, seq, {r('big_limit')}, {i('is_big_order is_huge_order')} FROM bigs", "bigs")


def big_order_stats(spark, d):
    return out(tk.big_order_stats(tk.flag_big_orders(wh.ticks(spark, d), CODE, fixed=100), CODE), "*")


BIG = """SELECT code, b AS big_order_count, b*100.0/n AS big_order_pct, CASE WHEN b > 0 THEN bb*100.0/b ELSE 0 END AS big_order_buy_ratio, h AS huge_order_count, h*100.0/n AS huge_order_pct
FROM (SELECT code, count(*) AS n, count(*) FILTER (is_big_order) AS b, count(*) FILTER (is_huge_order) AS h, count(*) FILTER (is_big_order AND direction = 1) AS bb FROM bigs GROUP BY code)"""
QUERIES["big_order_stats"] = big_order_stats
ORACLES["big_order_stats"] = sql(f"SELECT code, big_order_count, huge_order_count, {r('big_order_pct big_order_buy_ratio huge_order_pct')} FROM ({BIG})", "bigs")


def trader_flow(spark, d):
    return out(tk.trader_flow(wh.ticks(spark, d), CODE, 100), "*")


FLOW = """SELECT *, institutional_buy_vol - institutional_sell_vol AS institutional_net_flow, retail_buy_vol - retail_sell_vol AS retail_net_flow FROM (SELECT code,
 coalesce(sum(volume) FILTER (amount >= 100 AND direction = 1), 0) AS institutional_buy_vol, coalesce(sum(volume) FILTER (amount >= 100 AND direction = -1), 0) AS institutional_sell_vol,
 coalesce(sum(volume) FILTER (amount < 100 AND direction = 1), 0) AS retail_buy_vol, coalesce(sum(volume) FILTER (amount < 100 AND direction = -1), 0) AS retail_sell_vol FROM ticks GROUP BY code)"""
FLOW_COLS = "institutional_buy_vol institutional_sell_vol retail_buy_vol retail_sell_vol institutional_net_flow retail_net_flow"
QUERIES["trader_flow"] = trader_flow
ORACLES["trader_flow"] = sql(f"SELECT code, {r(FLOW_COLS)} FROM ({FLOW})", "ticks")

cte(
    "ofi",
    """SELECT *, (b - s)/(b + s + 1e-8) AS ofi FROM (SELECT *, row_number() OVER o - 1 AS pos, count(*) OVER (PARTITION BY code) AS size, sum(volume*direction) OVER o AS cum_delta,
 sum(CASE WHEN direction = 1 THEN volume ELSE 0 END) OVER f AS b, sum(CASE WHEN direction = -1 THEN volume ELSE 0 END) OVER f AS s FROM ticks
 WINDOW o AS (PARTITION BY code ORDER BY time, seq), f AS (PARTITION BY code ORDER BY time, seq ROWS 49 PRECEDING))""",
    "ticks",
)


def order_flow(spark, d):
    return out(tk.order_flow(wh.ticks(spark, d), CODE, BY_DAY), "code seq pos cum_delta ofi")


QUERIES["order_flow"] = order_flow
ORACLES["order_flow"] = sql(f"SELECT code, seq, pos, {r('cum_delta ofi')} FROM ofi", "ofi")


def tick_intensity(spark, d):
    return out(tk.tick_intensity(wh.ticks(spark, d), DATE, "minute"), "date slot ticks")


QUERIES["tick_intensity"] = tick_intensity
ORACLES["tick_intensity"] = sql(
    """SELECT date, slot, coalesce(ticks, 0) AS ticks FROM (SELECT date, UNNEST(generate_series(a, z, INTERVAL 1 MINUTE)) AS slot FROM (
SELECT date, min(date_trunc('minute', time)) AS a, max(date_trunc('minute', time)) AS z FROM ticks GROUP BY date))
LEFT JOIN (SELECT date, date_trunc('minute', time) AS slot, count(*) AS ticks FROM ticks GROUP BY ALL) USING (date, slot)""",
    "ticks",
)


def tick_surge(spark, d):
    return out(tk.tick_surge(wh.ticks(spark, d), DATE, "minute", 3.0, 20), "date slot ticks multiplier")


SURGE = """SELECT date, slot, ticks, ticks/m AS multiplier FROM (SELECT *, avg(ticks) OVER (PARTITION BY date) AS m, stddev_samp(ticks) OVER (PARTITION BY date) AS s, sum(ticks) OVER (PARTITION BY date) AS t FROM (
SELECT date, slot, coalesce(ticks, 0) AS ticks FROM (SELECT date, UNNEST(generate_series(a, z, INTERVAL 1 MINUTE)) AS slot FROM (
 SELECT date, min(date_trunc('minute', time)) AS a, max(date_trunc('minute', time)) AS z FROM ticks GROUP BY date))
LEFT JOIN (SELECT date, date_trunc('minute', time) AS slot, count(*) AS ticks FROM ticks GROUP BY ALL) USING (date, slot))) WHERE t >= 20 AND s > 0 AND ticks > m + 3*s"""
QUERIES["tick_surge"] = tick_surge
ORACLES["tick_surge"] = sql(f"SELECT date, slot, CAST(ticks AS BIGINT) AS ticks, {r('multiplier')} FROM ({SURGE})", "ticks")


def session_phases(spark, d):
    return out(tk.session_phases(wh.ticks(spark, d), DATE), "*")


QUERIES["session_phases"] = session_phases
ORACLES["session_phases"] = sql(
    f"""SELECT date, phase, tick_count, {r('volume amount buy_pct')} FROM (SELECT d.date, phase, count(t.seq) AS tick_count, coalesce(sum(volume), 0) AS volume, coalesce(sum(amount), 0) AS amount,
 CASE WHEN count(t.seq) > 0 THEN 100.0*count(t.seq) FILTER (direction = 1)/count(t.seq) ELSE 0 END AS buy_pct
FROM (SELECT DISTINCT date FROM ticks) d CROSS JOIN (VALUES {", ".join(f"('{p}', '{a}', '{z}')" for p, (a, z) in tk.PHASES.items())}) p(phase, a, z)
LEFT JOIN ticks t ON t.date = d.date AND strftime(time, '%H:%M') BETWEEN a AND z GROUP BY ALL)""",
    "ticks",
)

FEATURES = (
    "total_volume total_amount total_buy_vol total_sell_vol avg_trade_size max_trade_size trade_size_std price_high price_low median_trade_size "
    "trade_size_85pct trade_size_97pct ofi_mean ofi_std ofi_last_20 big_order_pct big_order_buy_ratio huge_order_pct " + FLOW_COLS +
    " net_buy_vol buy_sell_ratio net_flow_pct buy_tick_pct price_vwap price_range_pct"
)


def tick_features(spark, d):
    f = tk.tick_features(wh.ticks(spark, d), CODE, BY_DAY, 100)
    return out(f, f"code total_ticks big_order_count huge_order_count {FEATURES}")


QUERIES["tick_features"] = tick_features
ORACLES["tick_features"] = sql(
    f"""SELECT code, total_ticks, big_order_count, huge_order_count, {r(FEATURES)} FROM (SELECT a.*, o.* EXCLUDE (code), g.* EXCLUDE (code), f.* EXCLUDE (code),
 total_buy_vol - total_sell_vol AS net_buy_vol, CASE WHEN total_sell_vol > 0 THEN total_buy_vol/total_sell_vol END AS buy_sell_ratio,
 CASE WHEN total_buy_vol + total_sell_vol > 0 THEN (total_buy_vol - total_sell_vol)/(total_buy_vol + total_sell_vol)*100 ELSE 0 END AS net_flow_pct,
 buys*100.0/total_ticks AS buy_tick_pct, pv/total_volume AS price_vwap, (price_high - price_low)/pm*100 AS price_range_pct
FROM (SELECT code, count(*) AS total_ticks, sum(volume) AS total_volume, sum(amount) AS total_amount, coalesce(sum(volume) FILTER (direction = 1), 0) AS total_buy_vol, coalesce(sum(volume) FILTER (direction = -1), 0) AS total_sell_vol,
 count(*) FILTER (direction = 1) AS buys, avg(amount) AS avg_trade_size, max(amount) AS max_trade_size, stddev_samp(amount) AS trade_size_std, sum(price*volume) AS pv, max(price) AS price_high, min(price) AS price_low,
 median(price) AS pm, median(amount) AS median_trade_size, quantile_cont(amount, 0.85) AS trade_size_85pct, quantile_cont(amount, 0.97) AS trade_size_97pct FROM ticks GROUP BY code) a
JOIN (SELECT code, avg(ofi) AS ofi_mean, stddev_samp(ofi) AS ofi_std, avg(ofi) FILTER (pos >= size - 20) AS ofi_last_20 FROM ofi GROUP BY code) o USING (code)
JOIN ({BIG}) g USING (code) JOIN ({FLOW}) f USING (code))""",
    "ofi",
    "bigs",
)

cte(
    "bm",
    """SELECT code, date, time, seq, (b - a)/(b + a + 1e-8) AS depth_imbalance, (wb - wa)/(wb + wa + 1e-8) AS weighted_imbalance, (nb - na)/(nb + na + 1e-8) AS near_pressure, (mb - ma)/(mb + ma + 1e-8) AS mid_pressure,
 (fb - fa)/(fb + fa + 1e-8) AS far_pressure, best_bid, best_ask, CASE WHEN best_bid > 0 AND best_ask > 0 THEN (best_bid*a + best_ask*b)/(a + b + 1e-8) WHEN best_ask > 0 THEN (best_bid + best_ask)/2 ELSE best_bid END AS weighted_mid,
 CASE WHEN best_bid > 0 AND best_ask > 0 THEN (best_ask - best_bid)/best_bid*10000 END AS spread_bps FROM (
SELECT code, date, time, seq, sum(bid_volume) AS b, sum(ask_volume) AS a, sum(bid_volume*(11 - level)) AS wb, sum(ask_volume*(11 - level)) AS wa, sum(bid_volume) FILTER (level <= 3) AS nb, sum(ask_volume) FILTER (level <= 3) AS na,
 sum(bid_volume) FILTER (level BETWEEN 4 AND 7) AS mb, sum(ask_volume) FILTER (level BETWEEN 4 AND 7) AS ma, sum(bid_volume) FILTER (level >= 8) AS fb, sum(ask_volume) FILTER (level >= 8) AS fa,
 max(bid_price) FILTER (level = 1) AS best_bid, max(ask_price) FILTER (level = 1) AS best_ask FROM book GROUP BY ALL)""",
    "book",
)
BOOK = "best_bid best_ask depth_imbalance weighted_imbalance near_pressure mid_pressure far_pressure weighted_mid spread_bps"


def book_measures(spark, d):
    return out(tk.book_measures(wh.order_book(spark, d)), f"code seq {BOOK}")


QUERIES["book_measures"] = book_measures
ORACLES["book_measures"] = sql(f"SELECT code, seq, {r(BOOK)} FROM bm", "bm")

cte(
    "walls",
    """SELECT *, wall_ratio >= 5 AS is_strong FROM (SELECT code, date, time, seq, 'bid' AS side, level, bid_price AS price, bid_volume AS volume, bid_volume/avg(bid_volume) OVER (PARTITION BY seq) AS wall_ratio FROM book
UNION ALL SELECT code, date, time, seq, 'ask', level, ask_price, ask_volume, ask_volume/avg(ask_volume) OVER (PARTITION BY seq) FROM book) WHERE wall_ratio >= 3""",
    "book",
)


def order_walls(spark, d):
    return out(tk.order_walls(wh.order_book(spark, d)), "code seq side level price volume wall_ratio is_strong")


QUERIES["order_walls"] = order_walls
ORACLES["order_walls"] = sql(f"SELECT code, seq, side, CAST(level AS INT) AS level, {r('price volume wall_ratio')}, {i('is_strong')} FROM walls", "walls")


def spread_stats(spark, d):
    return out(tk.spread_stats(tk.book_measures(wh.order_book(spark, d))), "*")


QUERIES["spread_stats"] = spread_stats
ORACLES["spread_stats"] = sql(
    f"""SELECT code, date, snapshot_count, {r('mean_spread_bps max_spread_bps min_spread_bps spread_volatility_bps')} FROM (SELECT code, date, avg(spread_bps) AS mean_spread_bps, max(spread_bps) AS max_spread_bps,
 min(spread_bps) AS min_spread_bps, stddev_pop(spread_bps) AS spread_volatility_bps, count(spread_bps) AS snapshot_count FROM bm GROUP BY ALL)""",
    "bm",
)
BF = "depth_imbalance_mean depth_imbalance_std weighted_imbalance_mean mean_spread_bps weighted_mid best_bid best_ask near_pressure mid_pressure far_pressure strongest_wall_ratio"


def book_features(spark, d):
    return out(tk.book_features(wh.order_book(spark, d)), f"code date {BF} wall_count strongest_wall_side")


QUERIES["book_features"] = book_features
ORACLES["book_features"] = sql(
    f"""SELECT code, date, {r(BF)}, wall_count, strongest_wall_side FROM (SELECT g.*, l.* EXCLUDE (code, date, seq), coalesce(w.n, 0) AS wall_count, coalesce(w.m, 0) AS strongest_wall_ratio, w.s AS strongest_wall_side
FROM (SELECT code, date, avg(depth_imbalance) AS depth_imbalance_mean, stddev_pop(depth_imbalance) AS depth_imbalance_std, avg(weighted_imbalance) AS weighted_imbalance_mean, avg(spread_bps) AS mean_spread_bps FROM bm GROUP BY ALL) g
JOIN (SELECT code, date, seq, weighted_mid, best_bid, best_ask, near_pressure, mid_pressure, far_pressure FROM bm QUALIFY row_number() OVER (PARTITION BY code, date ORDER BY time DESC, seq DESC) = 1) l USING (code, date)
LEFT JOIN (SELECT seq, count(*) AS n, max(wall_ratio) AS m, first(side ORDER BY round(wall_ratio, 9) DESC, side = 'bid' DESC, level) AS s FROM walls GROUP BY seq) w USING (seq))""",
    "bm",
    "walls",
)


def whale_signals(spark, d):
    f = tk.tick_features(wh.ticks(spark, d), ("code", "date"), "date_trunc('hour', time)", 20)
    return out(tk.whale_signals(f, least=2, rise=5), "*")


QUERIES["whale_signals"] = whale_signals
WHALE = """SELECT code, date, 'whale_accumulation' AS signal_type, c.buy AS raw, 1 AS is_bullish FROM wh c WHERE total_ticks >= 2 AND br >= 60 AND up >= 2 AND rise <= 5 AND nf > 0
UNION ALL SELECT code, date, 'whale_distribution', c.sell, 0 FROM wh c WHERE total_ticks >= 2 AND br <= 40 AND down >= 2 AND nf < 0"""
cte(
    "wh",
    """SELECT *, (br - 50)*1.5 + up*8 + least(abs(nf)/10000, 20) AS buy, (50 - br)*1.5 + down*8 + least(abs(nf)/10000, 20) AS sell FROM (
SELECT *, count(*) FILTER (nb > 0) OVER f AS up, count(*) FILTER (nb < 0) OVER f AS down, max(vw) OVER f/first(vw) OVER f - 1 AS rise FROM (
SELECT code, date, count(*) AS total_ticks, sum(volume*direction) AS nb, sum(price*volume)/sum(volume) AS vw, coalesce(sum(volume*direction) FILTER (amount >= 20), 0) AS nf,
 CASE WHEN count(*) FILTER (amount >= big_limit) > 0 THEN 100.0*count(*) FILTER (amount >= big_limit AND direction = 1)/count(*) FILTER (amount >= big_limit) ELSE 0 END AS br
FROM ticks JOIN (SELECT code, date, CASE WHEN count(*) > 10 THEN quantile_cont(amount, 0.85) ELSE 20 END AS big_limit FROM ticks GROUP BY ALL) USING (code, date) GROUP BY ALL)
WINDOW f AS (PARTITION BY code ORDER BY date ROWS 4 PRECEDING))""",
    "ticks",
)
ORACLES["whale_signals"] = sql(
    f"SELECT code, date, signal_type, CASE WHEN raw > 75 THEN 'alert' ELSE 'warning' END AS severity, is_bullish, round(CAST(least(100, raw) AS DOUBLE), 6) AS confidence FROM ({WHALE})", "wh"
)


def wash_windows(spark, d):
    return out(tk.wash_windows(wh.ticks(spark, d), CODE, BY_DAY, 20, 1), "code win score")


cte(
    "wash",
    """SELECT code, win, least(b, s)/greatest(b, s + 1)*chg/n AS score FROM (SELECT o.code, k.win, count(*) AS n, coalesce(sum(volume) FILTER (direction = 1), 0) AS b, coalesce(sum(volume) FILTER (direction = -1), 0) AS s,
 count(*) FILTER (pos > k.win*10 AND direction <> pd) AS chg
FROM (SELECT *, lag(direction) OVER (PARTITION BY code ORDER BY time, seq) AS pd FROM ofi) o JOIN (SELECT code, UNNEST(range(0, max(size), 10))//10 AS win FROM ofi GROUP BY code) k ON k.code = o.code AND o.pos >= k.win*10 AND o.pos < k.win*10 + 20
WHERE k.win*10 < size - 20 GROUP BY ALL) WHERE greatest(b, s) >= 1""",
    "ofi",
)
QUERIES["wash_windows"] = wash_windows
ORACLES["wash_windows"] = sql(f"SELECT code, win, {r('score')} FROM wash", "wash")


def wash_signals(spark, d):
    return out(tk.wash_signals(wh.ticks(spark, d), CODE, BY_DAY, 50, 20, 1, 0.1, 0.2), "*")


QUERIES["wash_signals"] = wash_signals
ORACLES["wash_signals"] = sql(
    f"""SELECT code, 'wash_trading' AS signal_type, CASE WHEN wash_score*100 < 85 THEN 'warning' ELSE 'alert' END AS severity, 0 AS is_bullish, {r('confidence wash_score avg_score')}, windows FROM (
SELECT code, max(score) AS wash_score, least(100, max(score)*100) AS confidence, count(*) AS windows, avg(score) AS avg_score FROM wash WHERE score > 0.1 GROUP BY code) JOIN (SELECT code FROM ticks GROUP BY code HAVING count(*) >= 50) USING (code) WHERE wash_score >= 0.2""",
    "wash",
)


def anomaly_signals(spark, d):
    return out(tk.anomaly_signals(wh.ticks(spark, d), DATE, 4.0, 20), "*")


QUERIES["anomaly_signals"] = anomaly_signals
ORACLES["anomaly_signals"] = sql(
    f"""SELECT date, 'anomaly_trade' AS signal_type, CASE WHEN anomaly_count < n*0.02 THEN 'warning' ELSE 'alert' END AS severity, 0 AS is_bullish, anomaly_count, {r('confidence max_z_score anomaly_amount')} FROM (
SELECT date, count(*) AS anomaly_count, max(z) AS max_z_score, sum(amount) AS anomaly_amount, any_value(n) AS n, least(100, count(*)/any_value(n)*1000 + max(z)*5) AS confidence FROM (
SELECT *, (amount - avg(amount) OVER d)/stddev_samp(amount) OVER d AS z, count(*) OVER d AS n FROM ticks WINDOW d AS (PARTITION BY date)) WHERE z > 4 AND n >= 20 GROUP BY date)""",
    "ticks",
)


def merged_signals(spark, d):
    t, b = wh.ticks(spark, d), wh.order_book(spark, d)
    parts = [
        tk.anomaly_signals(t, DATE, 3.0, 20),
        tk.surge_signals(t, DATE, "minute", 3.0, 20),
        tk.wall_signals(b, DATE, 5.0),
        tk.imbalance_signals(b, DATE, 0.2),
    ]
    return out(tk.merge_signals(parts, DATE), "*")


QUERIES["merged_signals"] = merged_signals
ORACLES["merged_signals"] = sql(
    f"""SELECT date, signal_type, severity, is_bullish, round(CAST(confidence AS DOUBLE), 6) + 0.0 AS confidence, CAST(row_number() OVER (PARTITION BY date ORDER BY CASE severity WHEN 'alert' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END DESC, round(confidence, 9) DESC, signal_type) AS INT) AS signal_rank,
 count(*) OVER (PARTITION BY date) AS signal_count, CAST(bool_or(severity = 'alert') OVER (PARTITION BY date) AS INT) AS has_alert, CAST(bool_or(severity = 'warning') OVER (PARTITION BY date) AS INT) AS has_warning FROM (
SELECT date, 'anomaly_trade' AS signal_type, CASE WHEN count(*) < any_value(n)*0.02 THEN 'warning' ELSE 'alert' END AS severity, 0 AS is_bullish, CAST(least(100, count(*)/any_value(n)*1000 + max(z)*5) AS DOUBLE) AS confidence FROM (
 SELECT *, (amount - avg(amount) OVER d)/stddev_samp(amount) OVER d AS z, count(*) OVER d AS n FROM ticks WINDOW d AS (PARTITION BY date)) WHERE z > 3 AND n >= 20 GROUP BY date
UNION ALL SELECT date, 'tick_surge', CASE WHEN max(multiplier) < 5 THEN 'info' ELSE 'warning' END, 1, least(100, max(multiplier)*25) FROM ({SURGE}) GROUP BY date
UNION ALL SELECT date, 'order_wall', CASE WHEN side = 'bid' THEN 'info' ELSE 'warning' END, CAST(side = 'bid' AS INT), least(100, wall_ratio*15) FROM (SELECT * FROM walls QUALIFY row_number() OVER (PARTITION BY date ORDER BY round(wall_ratio, 9) DESC, side DESC, level, seq) = 1) WHERE wall_ratio >= 5
UNION ALL SELECT date, 'depth_imbalance', CASE WHEN abs(x) < 0.85 THEN 'warning' ELSE 'alert' END, CAST(x > 0 AS INT), least(100, abs(x)*120) FROM (SELECT date, depth_imbalance AS x FROM bm QUALIFY row_number() OVER (PARTITION BY date ORDER BY time DESC, seq DESC) = 1) WHERE abs(x) >= 0.2)""",
    "ticks",
    "walls",
    "bm",
)
