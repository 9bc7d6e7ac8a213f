"""Window functions (W) and indicators (T)."""

from __future__ import annotations

from tapeloom.functions import windows as w
from tapeloom.operators import indicators as ind
from tapeloom.suite.common import bars, indicators, out
from tapeloom.suite.sqlbase import ALL, S, cte, i, r, sql
from tapeloom.suite.sqlbase import w as sw

QUERIES, ORACLES = {}, {}


def moving_windows(spark, d):
    b = bars(spark, d)
    return out(
        b.selectExpr(
            "code",
            "date",
            f"{w.ma('close', 20)} AS ma20",
            f"{w.hhv('high', 10)} AS hhv10",
            f"{w.llv('low', 10)} AS llv10",
            f"{w.ref('close', 3)} AS ref3",
            f"{w.exist('close > open * 1.04D', 5)} AS exist5",
            f"{w.pct_change('close', 5)} AS pct5",
            f"{w.diff('close', 2)} AS diff2",
            f"{w.rolling_std('close', 20, 1)} AS std_sample",
            f"{w.rolling_std('close', 20, 0)} AS std_pop",
        ),
        "*",
    )


QUERIES["moving_windows"] = moving_windows
ORACLES["moving_windows"] = sql(
    f"""SELECT code, date, {r("ma20 hhv10 llv10 ref3 pct5 diff2 std_sample std_pop")}, {i("exist5")} FROM (
SELECT code, date, avg(close) OVER {sw(20)} AS ma20, max(high) OVER {sw(10)} AS hhv10, min(low) OVER {sw(10)} AS llv10,
 lag(close, 3) OVER {S} AS ref3, max(CASE WHEN close > open*1.04 THEN 1 ELSE 0 END) OVER {sw(5)} AS exist5,
 close/lag(close, 5) OVER {S} - 1 AS pct5, close - lag(close, 2) OVER {S} AS diff2,
 stddev_samp(close) OVER {sw(20)} AS std_sample, stddev_pop(close) OVER {sw(20)} AS std_pop FROM bars)""",
    "bars",
)


def rolling_statistics(spark, d):
    b = bars(spark, d).selectExpr("*", f"{w.ROW_INDEX} AS rn", f"{w.pct_change('close')} AS ret")
    b = b.selectExpr("*", f"{w.ref('ret')} AS ret_lag")
    return out(
        b.selectExpr(
            "code",
            "date",
            f"{w.rolling_pct_rank('volume', 20, 5)} AS rank_pct",
            f"{w.rolling_median('volume', 20, 15)} AS median20",
            f"{w.rolling_corr('ret', 'ret_lag', 20, 10)} AS autocorr",
            f"{w.rolling_slope('close', 10, 3)} AS slope10",
            f"{w.argmax('high', 'date', 20)} AS peak_date",
            f"{w.argmin('low', 'date', 20)} AS trough_date",
        ),
        "*",
    )


QUERIES["rolling_statistics"] = rolling_statistics
ORACLES["rolling_statistics"] = sql(
    f"""SELECT code, date, {r("rank_pct median20 autocorr slope10")}, peak_date, trough_date FROM (
SELECT code, date,
 CASE WHEN len(l) >= 5 THEN (len(list_filter(l, lambda x: x < volume)) + (len(list_filter(l, lambda x: x = volume)) + 1)/2.0)/len(l) END AS rank_pct,
 CASE WHEN n >= 15 THEN med END AS median20, CASE WHEN nc >= 10 THEN cr END AS autocorr, CASE WHEN n10 >= 3 THEN sl END AS slope10,
 peak_date, trough_date
FROM (SELECT *, list(volume) OVER {sw(20)} AS l, count(*) OVER {sw(20)} AS n, median(volume) OVER {sw(20)} AS med,
 count(ret_lag) OVER {sw(20)} AS nc, corr(ret, ret_lag) OVER {sw(20)} AS cr, count(*) OVER {sw(10)} AS n10,
 regr_slope(close, rn) OVER {sw(10)} AS sl, arg_max(date, high) OVER {sw(20)} AS peak_date, arg_min(date, low) OVER {sw(20)} AS trough_date
 FROM (SELECT *, lag(ret) OVER {S} AS ret_lag FROM (
  SELECT *, row_number() OVER {S} AS rn, close/lag(close) OVER {S} - 1 AS ret FROM bars))))""",
    "bars",
)


def cumulative_windows(spark, d):
    b = bars(spark, d).selectExpr("*", f"{w.ROW_INDEX} AS rn", f"{w.ref('close')} AS pc")
    up = "close > pc"
    return out(
        b.selectExpr(
            "code",
            "date",
            f"sum(volume) {w.SO_FAR} AS cum_volume",
            f"max(close) {w.SO_FAR} AS cum_max",
            f"exp(sum(ln(1 + least(abs(close / pc - 1), 0.01D))) {w.SO_FAR}) AS growth",
            f"{w.last_event(up, 'date')} AS last_up_date",
            f"{w.run_length(up)} AS up_run",
        ),
        "*",
    )


QUERIES["cumulative_windows"] = cumulative_windows
ORACLES["cumulative_windows"] = sql(
    f"""SELECT code, date, {r("cum_volume cum_max growth")}, last_up_date, {i("up_run")} FROM (
SELECT code, date, sum(volume) OVER {ALL} AS cum_volume, max(close) OVER {ALL} AS cum_max,
 product(1 + least(abs(close/pc - 1), 0.01)) OVER {ALL} AS growth,
 last_value(CASE WHEN close > pc THEN date END IGNORE NULLS) OVER {ALL} AS last_up_date,
 rn - coalesce(max(CASE WHEN close > pc THEN NULL ELSE rn END) OVER {ALL}, 0) AS up_run
FROM (SELECT *, row_number() OVER {S} AS rn, lag(close) OVER {S} AS pc FROM bars))""",
    "bars",
)


def double_line(spark, d):
    return out(ind.double_line(bars(spark, d)), "code date white_line yellow_line")


QUERIES["double_line"] = double_line
ORACLES["double_line"] = sql(f"SELECT code, date, {r('white_line yellow_line')} FROM ind", "ind")


def kdj(spark, d):
    return out(indicators(spark, d), "code date K D J")


QUERIES["kdj"] = kdj
ORACLES["kdj"] = sql("""SELECT code, date, round("K", 6) + 0.0 AS "K", round("D", 6) + 0.0 AS "D", round("J", 6) + 0.0 AS "J" FROM ind""", "ind")


def macd(spark, d):
    return out(indicators(spark, d), "code date dif dea macd")


QUERIES["macd"] = macd
ORACLES["macd"] = sql(f"SELECT code, date, {r('dif dea macd')} FROM ind", "ind")


def moving_averages(spark, d):
    return out(indicators(spark, d), "code date ma5 ma10 ma20 ma30 ma40 ma60")


QUERIES["moving_averages"] = moving_averages
ORACLES["moving_averages"] = sql(f"SELECT code, date, {r('ma5 ma10 ma20 ma30 ma40 ma60')} FROM ind", "ind")


def position_flags(spark, d):
    return out(
        ind.position_flags(indicators(spark, d)),
        "code date volume_shrink white_gt_yellow fall_in_bowl near_yellow near_white doubled",
    )


FLAGS = f"""SELECT *, volume < max(volume) OVER {sw(20)} * 0.9 AS volume_shrink, white_line > yellow_line AS white_gt_yellow,
 close >= yellow_line AND close <= white_line AS fall_in_bowl,
 close >= yellow_line AND (close - yellow_line)/yellow_line <= 0.035 AS near_yellow,
 abs(close - white_line)/white_line <= 0.035 AS near_white, max(high) OVER {sw(60)} > min(low) OVER {sw(60)} * 2.0 AS doubled FROM ind"""
cte("flags", FLAGS, "ind")
QUERIES["position_flags"] = position_flags
ORACLES["position_flags"] = sql(
    f"SELECT code, date, {i('volume_shrink white_gt_yellow fall_in_bowl near_yellow near_white doubled')} FROM flags", "flags"
)


def rsi_variants(spark, d):
    df = indicators(spark, d)
    return out(
        df.selectExpr("code", "date", "rsi_6", "rsi_14", f"{ind.rsi_simple()} AS rsi_simple", f"{ind.rsi_sum()} AS rsi_sum"), "*"
    )


QUERIES["rsi_variants"] = rsi_variants
ORACLES["rsi_variants"] = sql(
    f"""SELECT code, date, {r("rsi_6 rsi_14 rsi_simple rsi_sum")} FROM (
SELECT *, CASE WHEN n < 14 THEN NULL WHEN al = 0 AND ag > 0 THEN 100 WHEN al = 0 THEN 50 ELSE 100 - 100/(1 + ag/al) END AS rsi_simple,
 100 - 100/(1 + sg/greatest(sl, 0.001)) AS rsi_sum FROM (
SELECT *, count(pc) OVER {sw(14)} AS n, avg(CASE WHEN pc IS NOT NULL THEN gain END) OVER {sw(14)} AS ag,
 avg(CASE WHEN pc IS NOT NULL THEN loss END) OVER {sw(14)} AS al, sum(gain) OVER {sw(14)} AS sg, sum(loss) OVER {sw(14)} AS sl FROM ind))""",
    "ind",
)

cte(
    "momentum",
    f"""SELECT *, CASE WHEN sd > 0 THEN (close - (ma20 - 2*sd))/(4*sd) ELSE 0.5 END AS bb_pct_b,
 CASE WHEN sdp > 0 THEN (close - (ma20 - 2*sdp))/(4*sdp) ELSE 0.5 END AS bb_pct_pop,
 CASE WHEN h14 > l14x THEN (h14 - close)/(h14 - l14x)*-100 ELSE -50 END AS wr_14,
 avg(obv) OVER {sw(5)} AS obv_ma5, avg(tr) OVER {sw(10)} AS atr_10, avg(tr) OVER {sw(20)} AS atr_20, avg(tr3) OVER {sw(14)} AS atr_14,
 stddev_samp(ret) OVER {sw(10)}*100 AS std_ret_10d, obv > avg(obv) OVER {sw(5)} AS obv_trend_up,
 coalesce(macd > lag(macd, 3) OVER {S}, false) AS macd_hist_rising
FROM (SELECT *, close/pc - 1 AS ret, stddev_samp(close) OVER {sw(20)} AS sd, stddev_pop(close) OVER {sw(20)} AS sdp, max(high) OVER {sw(14)} AS h14, min(low) OVER {sw(14)} AS l14x,
 sum(sign(close - coalesce(pc, close))*volume) OVER {ALL} AS obv,
 CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc)) END AS tr,
 CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr3,
 {", ".join(f"(close/lag(close, {n}) OVER {S} - 1)*100 AS ret_{n}d" for n in (5, 10, 20, 60))},
 avg(CASE WHEN close > pc THEN 1.0 ELSE 0.0 END) OVER {sw(5)} AS bullish_ratio_5d,
 avg(CASE WHEN close > pc THEN 1.0 ELSE 0.0 END) OVER {sw(10)} AS bullish_ratio_10d,
 close = max(high) OVER {sw(20)} AS new_high_20d, avg(volume) OVER {sw(5)} AS vol_ma5, avg(volume) OVER {sw(20)} AS vol_ma20,
 avg(turnover) OVER {sw(5)} AS turnover_ma5, avg(turnover) OVER {sw(20)} AS turnover_ma20, max(turnover) OVER {sw(60)} AS turnover_max60
 FROM ind)""",
    "ind",
)


def band_and_range_indicators(spark, d):
    df = ind.momentum_columns(indicators(spark, d)).selectExpr("*", f"{ind.true_range(3)} AS tr3")
    return out(
        df.selectExpr(
            "code",
            "date",
            "bb_pct_b",
            f"{ind.bollinger_b(20, 0)} AS bb_pct_pop",
            "wr_14",
            "obv",
            "obv_ma5",
            "obv_trend_up",
            "atr_10",
            "atr_20",
            f"{w.ma('tr3', 14)} AS atr_14",
            "std_ret_10d",
        ),
        "*",
    )


QUERIES["band_and_range_indicators"] = band_and_range_indicators
ORACLES["band_and_range_indicators"] = sql(
    f"SELECT code, date, {r('bb_pct_b bb_pct_pop wr_14 obv obv_ma5 atr_10 atr_20 atr_14 std_ret_10d')}, {i('obv_trend_up')} FROM momentum",
    "momentum",
)


def return_and_volume_ratios(spark, d):
    return out(
        ind.momentum_columns(indicators(spark, d)),
        "code date ret_5d ret_10d ret_20d ret_60d bullish_ratio_5d bullish_ratio_10d new_high_20d vol_ma5 vol_ma20",
        "turnover_ma5 turnover_ma20 turnover_max60 macd_hist_rising",
    )


QUERIES["return_and_volume_ratios"] = return_and_volume_ratios
ORACLES["return_and_volume_ratios"] = sql(
    f"""SELECT code, date, {r("ret_5d ret_10d ret_20d ret_60d bullish_ratio_5d bullish_ratio_10d vol_ma5 vol_ma20 turnover_ma5 turnover_ma20 turnover_max60")},
 {i("new_high_20d macd_hist_rising")} FROM momentum""",
    "momentum",
)


def brick_chart(spark, d):
    return out(ind.brick_signal(indicators(spark, d)), "code date brick red_height green_height brick_signal")


cte(
    "bricks",
    f"""SELECT *, coalesce(green_height > 0 AND red_height > 0 AND red_height >= green_height*(2.0/3.0) AND close > yellow_line, false) AS brick_signal
FROM (SELECT *, brick - lag(brick) OVER {S} AS red_height, lag(brick, 2) OVER {S} - lag(brick) OVER {S} AS green_height FROM momentum)""",
    "momentum",
)
QUERIES["brick_chart"] = brick_chart
ORACLES["brick_chart"] = sql(f"SELECT code, date, {r('brick red_height green_height')}, {i('brick_signal')} FROM bricks", "bricks")
