"""Surges, waves and the gates inside them."""

from __future__ import annotations

from tapeloom.operators import indicators as ind
from tapeloom.operators import waves as wv
from tapeloom.suite.common import indicators, out
from tapeloom.suite.sqlbase import ALL, S, cte, i, r, sql
from tapeloom.suite.sqlbase import w as sw

QUERIES, ORACLES = {}, {}


def flagged(spark, d):
    return ind.position_flags(indicators(spark, d))


def annotated(spark, d):
    return wv.annotate(flagged(spark, d))


cte(
    "sur",
    f"""SELECT *, coalesce(pct_chg >= 4 AND close > open AND volume > vp5, false) AS is_surge,
 coalesce(pct_chg <= -5 AND volume > vp5*1.5, false) AS heavy_down FROM (
 SELECT *, (close - pc)/pc*100 AS pct_chg, avg(volume) OVER {sw(5, 1)} AS vp5 FROM flags)""",
    "flags",
)
cte(
    "sgr",
    f"""SELECT s.*, sum(CASE WHEN g.first_row THEN 1 ELSE 0 END) OVER {ALL.replace('code', 's.code').replace('date', 's.date')} AS grp, coalesce(g.first_row, false) AS group_start
FROM sur s LEFT JOIN (SELECT code, rn, coalesce(rn - lag(rn) OVER (PARTITION BY code ORDER BY rn) > 4, true) AS first_row FROM sur WHERE is_surge) g USING (code, rn)""",
    "sur",
)
# The group table, built with grouping and joins rather than windows.
cte(
    "gi",
    """SELECT a.*, p.rn AS peak FROM (SELECT code, grp, min(rn) AS s, max(rn) AS e, arg_min(coalesce(pc, open), rn) AS start_close, max(high) AS top FROM sgr WHERE grp > 0 GROUP BY ALL) a
JOIN (SELECT code, grp, high, min(rn) AS rn FROM sgr GROUP BY ALL) p ON p.code = a.code AND p.grp = a.grp AND p.high = a.top""",
    "sgr",
)
cte(
    "gl",
    """SELECT b.code, b.grp, b.s - a.peak - 1 AS gap,
 (SELECT max(volume) FROM sgr x WHERE x.code = a.code AND x.rn BETWEEN a.s AND a.peak) AS max_vol,
 (SELECT avg(volume) FROM sgr x WHERE x.code = a.code AND x.rn BETWEEN a.peak + 1 AND a.e AND x.rn > a.e - least(5, greatest(3, (a.e - a.peak)//2))) AS late_vol,
 (SELECT min(close) FROM sgr x WHERE x.code = a.code AND x.rn BETWEEN a.peak + 1 AND a.e) AS gap_low, a.start_close,
 EXISTS (SELECT 1 FROM sgr k JOIN sgr m ON m.code = k.code AND m.rn > k.rn AND m.close < k.low - 0.05
   WHERE k.code = a.code AND k.rn BETWEEN a.peak + 1 AND a.e AND k.close < k.yellow_line AND m.rn BETWEEN a.peak + 1 AND b.s) AS broken
FROM gi a JOIN gi b ON b.code = a.code AND b.grp = a.grp + 1""",
    "gi",
    "sgr",
)
cte(
    "wav",
    """SELECT s.*, ws.wave_start FROM sgr s LEFT JOIN (
 SELECT code, grp, max(CASE WHEN linked THEN NULL ELSE s END) OVER (PARTITION BY code ORDER BY grp) AS wave_start FROM (
  SELECT gi.*, coalesce(gap <= 15 AND NOT broken AND coalesce(late_vol < max_vol*0.7, true) AND coalesce(gap_low >= l.start_close*0.9, true), false) AS linked
  FROM gi LEFT JOIN gl l USING (code, grp))) ws ON ws.code = s.code AND ws.grp = s.grp""",
    "gi",
    "gl",
    "sgr",
)


def surge_groups(spark, d):
    return out(annotated(spark, d), "code date pct_chg vol_prev5 is_surge group_start grp wave_start")


QUERIES["surge_groups"] = surge_groups
ORACLES["surge_groups"] = sql(
    f"SELECT code, date, {r('pct_chg vol_prev5')}, {i('is_surge group_start')}, CAST(grp AS BIGINT) AS grp, CAST(wave_start AS INT) AS wave_start FROM (SELECT *, vp5 AS vol_prev5 FROM wav)", "wav"
)


def group_summary(spark, d):
    g = wv.group_measures(wv.surge_groups(wv.surge_days(flagged(spark, d)))).filter("group_start")
    return out(g, "code date grp rn g_peak g_gap g_max_vol g_start_close g_late_vol g_gap_low")


QUERIES["group_summary"] = group_summary
ORACLES["group_summary"] = sql(
    f"""SELECT x.code, x.date, CAST(x.grp AS BIGINT) AS grp, CAST(x.rn AS INT) AS rn, CAST(peak AS INT) AS g_peak, CAST(e - peak AS INT) AS g_gap, {r("g_max_vol g_start_close g_late_vol g_gap_low")} FROM (
SELECT a.code, a.date, a.grp, a.rn, b.peak, b.e, start_close AS g_start_close,
 max(x.volume) FILTER (x.rn <= b.peak) AS g_max_vol, avg(x.volume) FILTER (x.rn > b.peak AND x.rn > b.e - least(5, greatest(3, (b.e - b.peak)//2))) AS g_late_vol, min(x.close) FILTER (x.rn > b.peak) AS g_gap_low
FROM sgr a JOIN gi b ON a.code = b.code AND a.rn = b.s JOIN sgr x ON x.code = a.code AND x.rn BETWEEN b.s AND b.e GROUP BY ALL) x""",
    "gi",
    "sgr",
)

# Wave measures by brute force: every row joined with all rows of its wave up to it.
cte(
    "wm1",
    """SELECT a.code, a.rn, a.wave_start, count(*) AS wave_rows,
 count(*) FILTER (b.high > b.low AND (b.high - greatest(b.close, b.open))/(b.high - b.low) > 0.618) AS long_shadows,
 arg_min(coalesce(b.pc, b.open), b.rn) AS start_price, max(b.close) AS top_close, min(b.rn) FILTER (b.heavy_down) AS cut, max(b.volume) AS vtop,
 list_sort(list(b.volume), 'DESC') AS vols, max(b.high) AS top_high
FROM wav a JOIN wav b ON b.code = a.code AND b.rn BETWEEN a.wave_start AND a.rn GROUP BY ALL""",
    "wav",
)
cte(
    "wm2",
    """SELECT m.*, min(b.rn) FILTER (b.close = top_close) AS best, min(b.rn) FILTER (b.volume = vtop) AS r1,
 min(b.rn) FILTER (b.volume = vols[2]) AS r2, min(b.rn) FILTER (b.high = top_high) AS rh
FROM wm1 m JOIN wav b ON b.code = m.code AND b.rn BETWEEN m.wave_start AND m.rn GROUP BY ALL""",
    "wm1",
    "wav",
)
cte(
    "wm",
    f"""SELECT *, positive_vol > negative_vol*1.2 AS red_green_ok, total_gain <= 60 AND surge_turnover_sum <= 90 AND positive_vol > negative_vol*1.2 AS wave_ok,
 CASE WHEN wave_ok THEN least(10, 5 + CASE WHEN total_gain BETWEEN 15 AND 40 THEN 3 WHEN total_gain > 40 THEN 1 ELSE 0 END + CASE WHEN surge_turnover_sum < 45 THEN 1 ELSE 0 END + CASE WHEN positive_vol > negative_vol*1.5 THEN 1 ELSE 0 END) ELSE 0 END AS surge_quality,
 wave_ok AND shadow_ok AND max_vol_bullish AND second_vol_bullish AND high_day_bullish AND (wave_rows < 2 OR high_vol_rank > 0) AS is_qualified
FROM (SELECT m.code, m.rn, any_value(m.wave_start) AS wave_start, any_value(wave_rows) AS wave_rows, any_value(long_shadows) AS long_shadows,
  any_value(long_shadows) <= greatest(3, any_value(wave_rows)//6) AS shadow_ok, any_value(start_price) AS start_price, any_value(peak) AS peak_rn,
  (max(b.close) FILTER (b.rn = peak)/any_value(start_price) - 1)*100 AS total_gain,
  coalesce(sum(b.turnover) FILTER (b.is_surge AND b.rn <= peak), 0) AS surge_turnover_sum,
  coalesce(sum(b.volume) FILTER (b.close > b.open AND b.rn <= peak), 0) AS positive_vol, coalesce(sum(b.volume) FILTER (b.close < b.open AND b.rn <= peak), 0) AS negative_vol,
  coalesce(bool_or(lim) FILTER (b.rn <= peak), false) AS has_limit_up, coalesce(bool_or(lim AND (one OR b.volume < b.vp5)) FILTER (b.rn <= peak), false) AS has_shrink_limit_up, coalesce(bool_or(lim AND one) FILTER (b.rn <= peak), false) AS has_one_word_limit,
  coalesce(bool_or(surge_ratio > 2) FILTER (b.rn = m.wave_start), false) AS wave_healthy,
  bool_or(b.close > b.open) FILTER (b.rn = r1) AS max_vol_bullish, coalesce(bool_or(b.close > b.open) FILTER (b.rn = r2), true) AS second_vol_bullish, bool_or(b.close > b.open) FILTER (b.rn = rh) AS high_day_bullish,
  CASE WHEN any_value(wave_rows) < 2 THEN 0 WHEN max(b.volume) FILTER (b.rn = rh) >= any_value(vtop) THEN 1 WHEN max(b.volume) FILTER (b.rn = rh) >= any_value(vols[2]) THEN 2 ELSE 0 END AS high_vol_rank
 FROM (SELECT *, CASE WHEN top_close <= start_price THEN wave_start WHEN cut < best THEN cut - 1 ELSE best END AS peak FROM wm2) m
 JOIN (SELECT *, coalesce(pct_chg >= 9.8, false) OR ((high - low)/low*100 < 0.1 AND close = high) AS lim, abs(open - close)/open*100 < 0.5 AND abs(high - low)/low*100 < 0.5 AS one,
   CASE WHEN count(*) OVER {sw(10, 1)} >= 3 THEN volume/median(volume) OVER {sw(10, 1)} END AS surge_ratio FROM wav) b
 ON b.code = m.code AND b.rn BETWEEN m.wave_start AND m.rn GROUP BY m.code, m.rn)""",
    "wm2",
    "wav",
)


def wave_measures(spark, d):
    return out(
        wv.wave_measures(annotated(spark, d)),
        "code rn wave_start wave_rows long_shadows shadow_ok start_price peak_rn total_gain surge_turnover_sum positive_vol negative_vol",
        "red_green_ok wave_ok",
    )


QUERIES["wave_measures"] = wave_measures
ORACLES["wave_measures"] = sql(
    f"SELECT code, {i('rn wave_start wave_rows shadow_ok peak_rn red_green_ok wave_ok')}, long_shadows, {r('start_price total_gain surge_turnover_sum positive_vol negative_vol')} FROM wm", "wm"
)


def wave_quality(spark, d):
    return out(
        wv.wave_measures(annotated(spark, d)),
        "code rn has_limit_up has_shrink_limit_up has_one_word_limit wave_healthy max_vol_bullish second_vol_bullish high_day_bullish",
        "high_vol_rank surge_quality is_qualified",
    )


QUERIES["wave_quality"] = wave_quality
ORACLES["wave_quality"] = sql(
    f"SELECT code, {i('rn has_limit_up has_shrink_limit_up has_one_word_limit wave_healthy max_vol_bullish second_vol_bullish high_day_bullish high_vol_rank is_qualified')}, {r('surge_quality')} FROM wm", "wm"
)

cte(
    "wb1",
    """SELECT a.code, a.rn, a.wave_start, min(b.rn) FILTER (b.rn > a.wave_start AND b.close < b.yellow_line) AS under
FROM wav a JOIN wav b ON b.code = a.code AND b.rn BETWEEN a.wave_start AND a.rn GROUP BY ALL""",
    "wav",
)
cte(
    "wb2",
    """SELECT m.*, min(b.rn) AS break_rn FROM wb1 m LEFT JOIN wav u ON u.code = m.code AND u.rn = m.under
LEFT JOIN wav b ON b.code = m.code AND b.rn > m.under AND b.rn <= m.rn AND b.close < u.low - 0.05 GROUP BY ALL""",
    "wb1",
    "wav",
)
cte(
    "wb3",
    """SELECT m.*, CASE WHEN m.break_rn IS NULL THEN m.wave_start ELSE n.new_rn END AS wave_from FROM wb2 m LEFT JOIN (
 SELECT m.code, m.rn, min(x.rn) AS new_rn FROM wb2 m JOIN wav x ON x.code = m.code AND x.rn > m.break_rn AND x.rn <= m.rn AND x.pct_chg >= 4 AND x.close > x.open
  AND x.volume > (SELECT avg(volume) FROM wav v WHERE v.code = m.code AND v.rn BETWEEN greatest(m.break_rn, x.rn - 5) AND x.rn - 1) GROUP BY ALL) n USING (code, rn)""",
    "wb2",
    "wav",
)


def wave_break(spark, d):
    return out(wv.wave_break(annotated(spark, d)).filter("wave_start IS NOT NULL"), "code rn wave_start break_rn wave_broken wave_from")


QUERIES["wave_break"] = wave_break
ORACLES["wave_break"] = sql(
    f"SELECT code, {i('rn wave_start break_rn wave_from')}, CAST(break_rn IS NOT NULL AS INT) AS wave_broken FROM wb3", "wb3"
)


def _entry(spark, d):
    return wv.shrink_ratio(wv.super_b1(wv.washout(wv.wave_break(annotated(spark, d))), j_max=60, rebound=20, current_max=60, distance=0.3))


def wave_entry_flags(spark, d):
    return out(wv.washout_v3(_entry(spark, d)).filter("wave_from IS NOT NULL"), "code rn is_washout is_super_b1 vol_vs_wave_peak is_washout_v3")


cte(
    "wf",
    f"""SELECT a.*, b.break_rn, b.wave_from, lag(close) OVER {S.replace('code', 'a.code').replace('date', 'a.date')} AS c1, lag(yellow_line) OVER {S.replace('code', 'a.code').replace('date', 'a.date')} AS y1,
 lag("J") OVER {S.replace('code', 'a.code').replace('date', 'a.date')} AS j1, lag("J", 2) OVER {S.replace('code', 'a.code').replace('date', 'a.date')} AS j2
FROM wav a LEFT JOIN wb3 b USING (code, rn)""",
    "wav",
    "wb3",
)
cte(
    "we",
    """SELECT a.code, a.rn,
 max(b.rn) FILTER (b.rn > a.wave_from AND b.close < b.yellow_line AND b.c1 > b.y1) AS cross_rn,
 max(b.rn) FILTER (b.rn > a.wave_from AND b."J" < 60 AND b.white_gt_yellow AND b.volume_shrink) AS b1,
 a.volume/max(b.volume) FILTER (b.rn > a.rn - 20) AS vol_vs_wave_peak
FROM wf a JOIN wf b ON b.code = a.code AND b.rn BETWEEN a.wave_from AND a.rn GROUP BY a.code, a.rn, a.volume""",
    "wf",
)
cte(
    "entry_flags",
    """SELECT a.*, e.vol_vs_wave_peak,
 coalesce(a.close < a.yellow_line AND a.rn - a.wave_from + 1 >= 5 AND a.rn - e.cross_rn <= 5
  AND coalesce((SELECT volume FROM wf x WHERE x.code = a.code AND x.rn = e.cross_rn) <= 0.7*(SELECT avg(volume) FROM wf x WHERE x.code = a.code AND x.rn BETWEEN greatest(a.wave_from, e.cross_rn - 5) AND e.cross_rn - 1), true)
  AND a.close > (SELECT min(low) FROM wf x WHERE x.code = a.code AND x.rn BETWEEN e.cross_rn AND a.rn) - 0.05, false) AS is_washout,
 coalesce(e.b1 IS NOT NULL AND a.rn >= 40 AND a.rn - a.wave_from + 1 >= 5 AND (SELECT max("J") FROM wf x WHERE x.code = a.code AND x.rn BETWEEN e.b1 AND a.rn) >= 20
  AND a."J" < 60 AND a."J" - j1 >= j1 - j2 AND abs(a.close/(SELECT close FROM wf x WHERE x.code = a.code AND x.rn = e.b1) - 1) < 0.3, false) AS is_super_b1
FROM wf a JOIN we e USING (code, rn)""",
    "wf",
    "we",
)
QUERIES["wave_entry_flags"] = wave_entry_flags
ORACLES["wave_entry_flags"] = sql(
    f"""SELECT code, {i('rn is_washout is_super_b1 is_washout_v3')}, {r('vol_vs_wave_peak')} FROM (SELECT e.*, e.rn >= 40 AND e.close < e.yellow_line AND coalesce(e.volume <= v.a5*1.2, true) AS is_washout_v3
FROM entry_flags e JOIN (SELECT code, rn, avg(volume) OVER {sw(5, 1)} AS a5 FROM flags) v USING (code, rn))""",
    "entry_flags",
)


def washout_recovered(spark, d):
    return out(wv.washout_recovered(indicators(spark, d)), "*")


QUERIES["washout_recovered"] = washout_recovered
ORACLES["washout_recovered"] = sql(
    f"""SELECT code, break_date, arg_min(rd, k) AS recover_date, round(min(low) FILTER (k <= kk), 6) + 0.0 AS washout_low FROM (
SELECT a.code, a.date AS break_date, b.low, b.rn - a.rn AS k, CASE WHEN b.rn > a.rn AND b.close > b.yellow_line THEN b.date END AS rd,
 min(CASE WHEN b.rn > a.rn AND b.close > b.yellow_line THEN b.rn - a.rn END) OVER (PARTITION BY a.code, a.rn) AS kk
FROM (SELECT *, lag(close) OVER {S} AS c1, lag(yellow_line) OVER {S} AS y1, avg(volume) OVER {sw(5, 1)} AS a5 FROM ind) a
JOIN ind b ON b.code = a.code AND b.rn BETWEEN a.rn AND a.rn + 3 WHERE a.close < a.yellow_line AND a.c1 > a.y1 AND a.volume <= a.a5*0.7)
WHERE kk IS NOT NULL GROUP BY code, break_date""".replace("arg_min(rd, k)", "arg_min(rd, k) FILTER (rd IS NOT NULL)"),
    "ind",
)


def s1_flags(spark, d):
    return out(wv.s1_scan_start(wv.s1_flags(annotated(spark, d))).filter("wave_start IS NOT NULL"), "code rn s1_heavy_bear s1_windmill s1_second_high scan_from")


QUERIES["s1_flags"] = s1_flags
ORACLES["s1_flags"] = sql(
    f"""SELECT code, {i('rn s1_heavy_bear s1_windmill s1_second_high scan_from')} FROM (SELECT a.code, a.rn,
 coalesce(a.up AND a.close < a.open AND (a.volume/a.pv >= 1.5 OR coalesce(a.volume/g.v20 >= 2, false) OR coalesce(a.volume >= g.bullmax*0.9, false)) AND ((g.rh > g.rl AND (a.close - g.rl)/(g.rh - g.rl) >= 0.7) OR coalesce(g.near3 >= coalesce(g.highs[3], -1), false)), false) AS s1_heavy_bear,
 coalesce(a.up AND a.rn > a.wave_start AND a.high > a.low AND (a.high - greatest(a.close, a.open))/(a.high - a.low) > 0.618 AND a.pct_chg < 2 AND a.volume > g.vmean*1.5 AND a.volume >= g.vmax*0.99, false) AS s1_windmill,
 coalesce(a.up AND a.high >= g.rh*0.97 AND (a.close <= a.open OR (a.close < a.pc AND a.close > a.open)) AND a.rn - a.wave_start >= 3 AND a.volume >= g.vprior*0.99 AND (g.hc - a.open)/g.hc*100 > 0 AND (g.hc - a.open)/g.hc*100 < 3.82, false) AS s1_second_high,
 CASE WHEN a.rn - a.wave_start + 1 < 10 THEN coalesce(l.low_rn, a.wave_start) ELSE a.wave_start END AS scan_from
FROM (SELECT *, ma5 > ma10 AND ma10 > ma20 AS up, lag(volume) OVER {S} AS pv FROM wav) a
JOIN (SELECT a.code, a.rn, avg(b.volume) FILTER (b.rn BETWEEN a.rn - 20 AND a.rn - 1) AS v20, max(b.volume) FILTER (b.close > b.open) AS bullmax,
  max(b.high) FILTER (b.rn > a.rn - 20) AS rh, min(b.low) FILTER (b.rn > a.rn - 20) AS rl, list_sort(list(b.high), 'DESC') AS highs, max(b.high) FILTER (b.rn BETWEEN a.rn - 3 AND a.rn - 1) AS near3,
  avg(b.volume) FILTER (b.rn < a.rn) AS vmean, max(b.volume) AS vmax, max(b.volume) FILTER (b.rn < a.rn) AS vprior, arg_max(b.close, b.high) AS hc
  FROM wav a JOIN wav b ON b.code = a.code AND b.rn BETWEEN a.wave_start AND a.rn GROUP BY ALL) g USING (code, rn)
LEFT JOIN (SELECT code, rn, arg_min(rn, close) OVER {sw(120, 1)} AS low_rn FROM wav) l ON l.code = a.code AND l.rn = a.wave_start)""",
    "wav",
)


def entry_scans(spark, d):
    df = wv.reversal_flags(wv.b3_scan(wv.b2_signal(indicators(spark, d)), prior_gain=5, low=0, high=50, cap_min=0, gap=50, shadow=30, vol_low=0.1, vol_high=3))
    return out(df, "code date b2_signal b3 didi up_spike distribution_3d")


QUERIES["entry_scans"] = entry_scans
ORACLES["entry_scans"] = sql(
    f"""SELECT code, date, {i("b2_signal b3 didi up_spike distribution_3d")} FROM (SELECT code, date,
 coalesce((close - pc)/pc*100 >= 4 AND close >= open AND high - close <= (close - open)*1.2 AND volume >= pv*1.5 AND volume >= CASE WHEN rn >= 6 THEN a5 ELSE pv END*1.5, false) AS b2_signal,
 coalesce((pc - pc2)/pc2*100 >= 5 AND (close - pc)/pc*100 BETWEEN 0 AND 50 AND close > open AND (open/pc - 1)*100 < 50 AND (high - close)/close*100 <= 30 AND (open - low)/open*100 <= 30 AND volume/pv BETWEEN 0.1 AND 3 AND white_line > yellow_line AND close > yellow_line AND market_cap > 0, false) AS b3,
 coalesce(close < least(o2, pc2), false) AS didi, coalesce((close - pc)/pc*100 > 3 AND (high - greatest(close, open))/close*100 > 2 AND volume > a3*1.2 AND rn >= 4, false) AS up_spike, coalesce(close < o2, false) AS distribution_3d
FROM (SELECT *, lag(close, 2) OVER {S} AS pc2, lag(open, 2) OVER {S} AS o2, lag(volume) OVER {S} AS pv, avg(volume) OVER {sw(5, 1)} AS a5, avg(volume) OVER {sw(3, 1)} AS a3 FROM ind))""",
    "ind",
)


def bonus_points(spark, d):
    return out(wv.bonus_points(indicators(spark, d)), "code date bonus")


QUERIES["bonus_points"] = bonus_points
ORACLES["bonus_points"] = sql(
    f"""SELECT code, date, CAST(CASE WHEN rn >= 50 AND close <= pl*1.02 AND volume > vl*1.1 THEN 5 ELSE 0 END + CASE WHEN rn >= 50 AND dif > dl AND close <= pl*1.02 THEN 5 ELSE 0 END
 + CASE WHEN rn >= 50 AND sc > 1e-9 AND sv > 1e-9 THEN 3 ELSE 0 END AS INT) AS bonus FROM (
SELECT *, min(close) OVER {sw(50)} AS pl, min(volume) OVER {sw(50)} AS vl, min(dif) OVER {sw(50)} AS dl, regr_slope(close, rn) OVER {sw(10)} AS sc, regr_slope(volume, rn) OVER {sw(10)} AS sv FROM ind)""",
    "ind",
)


def signal_select(spark, d):
    df = wv.wave_measures(_entry(spark, d))
    return out(
        wv.select_signals(df, j_max=60, cap_min=0, max_shrink=0.95, near_pct=20, check_double=False, check_wave=False, min_rows=30),
        "code date close J is_washout is_super_b1 total_gain surge_turnover_sum high_vol_rank wave_from",
    )


QUERIES["signal_select"] = signal_select
ORACLES["signal_select"] = sql(
    f"""SELECT e.code, e.date, {r('close')}, round(e."J", 6) + 0.0 AS "J", {i('is_washout is_super_b1 high_vol_rank wave_from')}, {r('total_gain surge_turnover_sum')}
FROM entry_flags e JOIN wm USING (code, rn) WHERE e.rn >= 30 AND e.white_gt_yellow AND e."J" < 60 AND e.dif > 0 AND e.market_cap >= 0 AND shadow_ok
 AND e.wave_from IS NOT NULL AND vol_vs_wave_peak < 0.95 AND (e.fall_in_bowl OR abs(e.close - e.white_line)/e.white_line <= 0.2 OR is_washout)""",
    "entry_flags",
    "wm",
)
