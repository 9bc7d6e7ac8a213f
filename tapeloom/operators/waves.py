"""Volume surges, the waves they start, and the gates evaluated inside a wave.

A wave seen from a given row needs only rows up to that row. Whether two neighbouring surge groups
belong to one wave depends on those two groups alone, so a wave is an island of linked groups and
each row belongs to exactly one wave. Every measure is then a running window over
(code, wave start): linear in the number of bars, without re-reading the prefix of each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tapeloom.functions import windows as w

STOP_WIDTH = 0.05


def surge_days(df: DataFrame, gain: float = 4.0, volume_ratio: float = 1.0, lookback: int = 5) -> DataFrame:
    """Flag rows that rise by ``gain`` percent on a bullish bar above the mean of earlier volume."""
    return df.selectExpr(
        "*", "(close - pc) / pc * 100 AS pct_chg", f"avg(volume) {w.rows(lookback, 1)} AS vol_prev5"
    ).selectExpr(
        "*", f"coalesce(pct_chg >= {gain} AND close > open AND volume > vol_prev5 * {volume_ratio}D, false) AS is_surge"
    )


def surge_groups(df: DataFrame, gap: int = 4) -> DataFrame:
    """Number the islands of surge rows at most ``gap`` rows apart; rows keep the latest group."""
    out = df.selectExpr("*", f"max(CASE WHEN is_surge THEN rn END) {w.BEFORE} AS _last")
    out = out.selectExpr("*", f"is_surge AND (_last IS NULL OR rn - _last > {gap}) AS group_start").drop("_last")
    return out.selectExpr("*", f"count_if(group_start) {w.SO_FAR} AS grp")


def group_measures(df: DataFrame) -> DataFrame:
    """Measures of each complete group, repeated on its rows: peak, volume, gap after the peak."""
    g = w.group("code", "grp")
    out = df.selectExpr(
        "*",
        f"max_by(rn, struct(high, -rn)) {g} AS g_peak",
        f"min(rn) {g} AS g_first",
        f"max(rn) {g} AS g_last",
        f"max(CASE WHEN group_start THEN coalesce(pc, open) END) {g} AS g_start_close",
    )
    below = f"max(CASE WHEN rn > g_peak AND close < yellow_line THEN low END)"
    out = out.selectExpr(
        "*",
        f"max(CASE WHEN rn <= g_peak THEN volume END) {g} AS g_max_vol",
        "g_last - g_peak AS g_gap",
        f"{below} {w.running('code, grp', skip=1)} - {STOP_WIDTH}D AS _stop",
        f"{below} {g} - {STOP_WIDTH}D AS g_stop",
    )
    late = "least(5, greatest(3, CAST(floor(g_gap / 2) AS INT)))"
    return out.selectExpr(
        *[c for c in out.columns if c != "_stop"],
        f"avg(CASE WHEN rn > g_peak AND rn > g_last - {late} THEN volume END) {g} AS g_late_vol",
        f"min(CASE WHEN rn > g_peak THEN close END) {g} AS g_gap_low",
        f"max(coalesce(rn > g_peak AND close < _stop, false)) {g} AS g_broken",
    )


def waves(df: DataFrame, gap: int = 15, late_ratio: float = 0.7, hold: float = 0.9) -> DataFrame:
    """Link a group to the one before it, and give each row the first row of its wave.

    A link needs a short gap, no break below the stop of a close under the yellow line, late gap
    volume under ``late_ratio`` of the group's peak, and closes above ``hold`` of its start.
    """
    p = {c: w.ref(f"g_{c}") for c in ("gap", "broken", "stop", "late_vol", "max_vol", "gap_low", "start_close")}
    linked = (
        f"{p['gap']} <= {gap} AND NOT {p['broken']} AND coalesce(close >= {p['stop']}, true)"
        f" AND coalesce({p['late_vol']} < {p['max_vol']} * {late_ratio}D, true)"
        f" AND coalesce({p['gap_low']} >= {p['start_close']} * {hold}D, true)"
    )
    out = df.selectExpr("*", f"group_start AND grp > 1 AND {linked} AS group_linked")
    return out.selectExpr(
        "*", f"last(CASE WHEN group_start AND NOT coalesce(group_linked, false) THEN rn END, true) {w.SO_FAR} AS wave_start"
    )


def annotate(df: DataFrame) -> DataFrame:
    """Indicators and flags -> surge, group and wave columns."""
    out = waves(group_measures(surge_groups(surge_days(df))))
    return out.drop(*[c for c in out.columns if c.startswith("g_")])


def wave_measures(df: DataFrame, max_gain: float = 60.0, max_turnover: float = 90.0, red_green: float = 1.2) -> DataFrame:
    """Measures of the wave as seen from each of its rows; rows before any surge are dropped."""
    by = "code, wave_start"
    run, prior = w.running(by), w.running(by, skip=1)
    keep = list(df.columns)
    long_shadow = "high > low AND (high - greatest(close, open)) / (high - low) > 0.618D"
    limit = "coalesce(pct_chg >= 9.8D, false) OR ((high - low) / low * 100 < 0.1D AND close = high)"
    one_word = "abs(open - close) / open * 100 < 0.5D AND abs(high - low) / low * 100 < 0.5D"
    base = f"percentile(volume, 0.5) {w.rows(10, 1)}"
    out = df.selectExpr(
        "*",
        f"CASE WHEN count(1) {w.rows(10, 1)} >= 3 THEN try_divide(volume, {base}) END AS _surge_ratio",
        f"({limit}) AS _limit",
        f"({one_word}) AS _one",
        "close > open AS _bull",
        "coalesce(pct_chg <= -5 AND volume > vol_prev5 * 1.5D, false) AS _heavy_down",
    ).filter("wave_start IS NOT NULL")
    out = out.selectExpr(
        "*",
        "rn - wave_start + 1 AS wave_rows",
        f"count_if({long_shadow}) {run} AS long_shadows",
        f"first(coalesce(pc, open)) {run} AS start_price",
        f"first(_surge_ratio) {run} AS surge_volume_ratio",
        f"coalesce(sum(CASE WHEN is_surge THEN turnover END) {run}, 0D) AS _to",
        f"sum(CASE WHEN close > open THEN volume ELSE 0D END) {run} AS _pos",
        f"sum(CASE WHEN close < open THEN volume ELSE 0D END) {run} AS _neg",
        f"count_if(_limit) {run} AS _lim",
        f"count_if(_limit AND _one) {run} AS _onew",
        f"count_if(_limit AND (_one OR volume < vol_prev5)) {run} AS _shr",
        f"max(volume) {prior} AS _m1",
        f"max_by(struct(rn, _bull), struct(volume, -rn)) {prior} AS _top",
    )
    # Second-largest volume so far: each row either displaces the largest or competes below it.
    out = out.selectExpr(
        "*",
        "struct(close, -rn AS ord, rn, _to, _pos, _neg, _lim, _onew, _shr) AS _state",
        "CASE WHEN _m1 IS NULL THEN NULL WHEN volume >= _m1 THEN struct(_m1 AS v, -_top.rn AS ord, _top._bull AS bull) "
        "ELSE struct(volume AS v, -rn AS ord, _bull AS bull) END AS _second",
    )
    out = out.selectExpr(
        "*",
        f"max(_state) {run} AS _best",
        f"first(_state) {run} AS _first",
        f"lag(_state) OVER (PARTITION BY {by} ORDER BY date) AS _prev",
        f"max(_second) {run} AS _sec",
        f"max(volume) {run} AS _v1",
        f"max_by(_bull, struct(volume, -rn)) {run} AS max_vol_bullish",
        f"max_by(struct(volume, _bull), struct(high, -rn)) {run} AS _high",
    )
    out = out.selectExpr("*", f"first(CASE WHEN _heavy_down THEN _prev END, true) {run} AS _cut")
    out = out.selectExpr(
        "*",
        "CASE WHEN _best.close <= start_price THEN _first WHEN _cut.rn + 1 < _best.rn THEN _cut ELSE _best END AS _end",
    )
    out = out.selectExpr(
        *keep,
        "wave_rows",
        "long_shadows",
        "long_shadows <= greatest(3, CAST(floor(wave_rows / 6) AS INT)) AS shadow_ok",
        "start_price",
        "_end.rn AS peak_rn",
        "(_end.close / start_price - 1) * 100 AS total_gain",
        "_end._to AS surge_turnover_sum",
        "_end._pos AS positive_vol",
        "_end._neg AS negative_vol",
        "_end._lim > 0 AS has_limit_up",
        "_end._shr > 0 AS has_shrink_limit_up",
        "_end._onew > 0 AS has_one_word_limit",
        "coalesce(surge_volume_ratio > 2, false) AS wave_healthy",
        "max_vol_bullish",
        "coalesce(_sec.bull, true) AS second_vol_bullish",
        "_high._bull AS high_day_bullish",
        "CASE WHEN wave_rows < 2 THEN 0 WHEN _high.volume >= _v1 THEN 1 WHEN _high.volume >= _sec.v THEN 2 ELSE 0 END AS high_vol_rank",
    )
    quality = (
        "5D + CASE WHEN total_gain BETWEEN 15 AND 40 THEN 3D WHEN total_gain > 40 THEN 1D ELSE 0D END"
        f" + CASE WHEN surge_turnover_sum < {max_turnover * 0.5}D THEN 1D ELSE 0D END"
        f" + CASE WHEN positive_vol > negative_vol * {red_green + 0.3}D THEN 1D ELSE 0D END"
    )
    return out.selectExpr(
        "*",
        f"positive_vol > negative_vol * {red_green}D AS red_green_ok",
        f"total_gain <= {max_gain} AND surge_turnover_sum <= {max_turnover} AND positive_vol > negative_vol * {red_green}D "
        "AS wave_ok",
    ).selectExpr(
        "*",
        f"CASE WHEN wave_ok THEN least({quality}, 10D) ELSE 0D END AS surge_quality",
        "wave_ok AND shadow_ok AND max_vol_bullish AND second_vol_bullish AND high_day_bullish "
        "AND (wave_rows < 2 OR high_vol_rank > 0) AS is_qualified",
    )


def wave_break(df: DataFrame, gain: float = 4.0, least_after: int = 1) -> DataFrame:
    """Break of a wave, and the row from which its measures count.

    The first close under the yellow line sets a stop below its low; a later close under the stop
    breaks the wave. After a break the wave counts from the first new surge, judged on the rows
    since the break only; until then ``wave_from`` is null.
    """
    by = "code, wave_start"
    run = w.running(by)
    under = "rn > wave_start AND close < yellow_line"
    keep = list(df.columns)
    out = df.selectExpr(
        "*",
        f"min(CASE WHEN {under} THEN rn END) {run} AS _under",
        f"first(CASE WHEN {under} THEN low - {STOP_WIDTH}D END, true) {run} AS _stop",
    )
    out = out.selectExpr("*", f"min(CASE WHEN rn > _under AND close < _stop THEN rn END) {run} AS break_rn")
    since = f"{by}, break_rn"
    out = out.selectExpr("*", f"avg(volume) {w.rows(5, 1, since)} AS _v5")
    fresh = f"break_rn IS NOT NULL AND rn > break_rn AND pct_chg >= {gain} AND close > open AND volume > _v5"
    out = out.selectExpr("*", f"min(CASE WHEN {fresh} THEN rn END) {w.running(since)} AS _new")
    seen = f"CASE WHEN rn - break_rn + 1 >= {least_after} THEN _new END"
    return out.selectExpr(
        *keep,
        "break_rn",
        "break_rn IS NOT NULL AS wave_broken",
        f"CASE WHEN break_rn IS NULL THEN wave_start ELSE {seen} END AS wave_from",
    )


def washout(df: DataFrame, shrink: float = 0.7, within: int = 5) -> DataFrame:
    """A shrinking cross under the yellow line, at most ``within`` rows ago, whose low still holds."""
    by = "code, wave_from"
    keep = list(df.columns)
    out = df.selectExpr(
        "*",
        f"rn > wave_from AND close < yellow_line AND {w.ref('close')} > {w.ref('yellow_line')} AS _cross",
        f"volume <= avg(volume) {w.rows(5, 1, by)} * {shrink}D AS _calm",
    )
    run = w.running(by)
    out = out.selectExpr(
        "*",
        f"last(CASE WHEN _cross THEN rn END, true) {run} AS _cross_rn",
        f"last(CASE WHEN _cross THEN coalesce(_calm, true) END, true) {run} AS _was_calm",
    )
    out = out.selectExpr("*", f"min(low) {w.running(by + ', _cross_rn')} AS _low")
    return out.selectExpr(
        *keep,
        "coalesce(wave_from IS NOT NULL AND close < yellow_line AND rn - wave_from + 1 >= 5 "
        f"AND rn - _cross_rn <= {within} AND _was_calm AND close > _low - {STOP_WIDTH}D, false) AS is_washout",
    )


def washout_v3(df: DataFrame, within: int = 10, volume_ratio: float = 1.2) -> DataFrame:
    """Close under the yellow line now, without heavy volume against the five rows before."""
    return df.selectExpr(
        "*",
        f"rn >= 40 AND close < yellow_line AND coalesce(volume <= avg(volume) {w.rows(5, 1)} * {volume_ratio}D, true) "
        "AS is_washout_v3",
    )


def washout_recovered(df: DataFrame, shrink: float = 0.7) -> DataFrame:
    """Rows that cross under the yellow line on shrinking volume and recover within three rows."""
    back = [f"({w.lead('close', k)} > {w.lead('yellow_line', k)})" for k in (1, 2, 3)]
    rec = f"CASE WHEN {back[0]} THEN 1 WHEN {back[1]} THEN 2 WHEN {back[2]} THEN 3 END"
    out = df.selectExpr(
        "*",
        f"{rec} AS _k",
        f"close < yellow_line AND {w.ref('close')} > {w.ref('yellow_line')} "
        f"AND volume <= avg(volume) {w.rows(5, 1)} * {shrink}D AS _cross",
        *[f"{w.lead('low', k)} AS _l{k}" for k in (1, 2, 3)],
        *[f"{w.lead('date', k)} AS _d{k}" for k in (1, 2, 3)],
    ).filter("_cross AND _k IS NOT NULL")
    return out.selectExpr(
        "code",
        "date AS break_date",
        "CASE _k WHEN 1 THEN _d1 WHEN 2 THEN _d2 ELSE _d3 END AS recover_date",
        "CASE _k WHEN 1 THEN least(low, _l1) WHEN 2 THEN least(low, _l1, _l2) ELSE least(low, _l1, _l2, _l3) END AS washout_low",
    )


def super_b1(df: DataFrame, j_max: float = 34, rebound: float = 20, current_max: float = 20, distance: float = 0.04) -> DataFrame:
    """An earlier entry in the wave, J rebounded since, J low again and flattening, price close by."""
    by = "code, wave_from"
    keep = list(df.columns)
    entry = f"rn > wave_from AND J < {j_max} AND white_gt_yellow AND volume_shrink"
    out = df.selectExpr("*", f"last(CASE WHEN {entry} THEN rn END, true) {w.running(by)} AS _b1")
    since = w.running(f"{by}, _b1")
    out = out.selectExpr(
        "*",
        f"max(J) {since} AS _jmax",
        f"first(close) {since} AS _b1_close",
        f"(J - {w.ref('J')}) >= ({w.ref('J')} - {w.ref('J', 2)}) AS _flat",
    )
    return out.selectExpr(
        *keep,
        "coalesce(wave_from IS NOT NULL AND _b1 IS NOT NULL AND rn >= 40 AND rn - wave_from + 1 >= 5 "
        f"AND _jmax >= {rebound} AND J < {current_max} AND _flat AND abs(close / _b1_close - 1) < {distance}D, false) AS is_super_b1",
    )


def shrink_ratio(df: DataFrame, n: int = 20) -> DataFrame:
    """Volume against the largest of the last ``n`` rows inside the wave."""
    return df.selectExpr("*", f"CASE WHEN wave_from IS NOT NULL THEN volume / max(volume) {w.rows(n, 0, 'code, wave_from')} END AS vol_vs_wave_peak")


def s1_flags(df: DataFrame, prev_ratio: float = 1.5, ma20_ratio: float = 2.0, bull_ratio: float = 0.9, price_pos: float = 0.7) -> DataFrame:
    """Distribution days as seen on the day: heavy bearish bar, windmill, and weak second high.

    The third-highest high so far is found like the second: by what each row displaces.
    """
    by = "code, wave_start"
    run, prior = w.running(by), w.running(by, skip=1)
    keep = list(df.columns)
    out = df.selectExpr(
        "*",
        "wave_start IS NOT NULL AND ma5 > ma10 AND ma10 > ma20 AS _up",
        f"{w.ref('volume')} AS _pv",
        f"avg(volume) {w.rows(20, 1, by)} AS _v20",
        f"max(CASE WHEN close > open THEN volume END) {run} AS _bullmax",
        f"max(high) {w.rows(20, 0, by)} AS _rh",
        f"min(low) {w.rows(20, 0, by)} AS _rl",
        f"max(high) {prior} AS _h1",
        f"avg(volume) {prior} AS _vmean",
        f"max(volume) {run} AS _vmax",
        f"max(volume) {prior} AS _vmax_prior",
        f"max_by(close, struct(high, -rn)) {run} AS _high_close",
    )
    out = out.selectExpr("*", "CASE WHEN _h1 IS NOT NULL THEN least(high, _h1) END AS _d1").selectExpr("*", f"max(_d1) {prior} AS _h2")
    out = out.selectExpr("*", "CASE WHEN _h2 IS NOT NULL THEN least(_d1, _h2) END AS _d2").selectExpr("*", f"max(_d2) {run} AS _h3")
    near_top = " OR ".join(
        f"(rn - {k} >= wave_start AND coalesce({w.ref('high', k)} >= _h3, true))" for k in (1, 2, 3)
    )
    heavy = f"(volume / _pv >= {prev_ratio} OR coalesce(volume / _v20 >= {ma20_ratio}, false) OR coalesce(volume >= _bullmax * {bull_ratio}D, false))"
    pos = f"(_rh > _rl AND (close - _rl) / (_rh - _rl) >= {price_pos}D)"
    real_bear = "(close <= open OR (close < pc AND close > open))"
    return out.selectExpr(
        *keep,
        f"coalesce(_up AND close < open AND {heavy} AND ({pos} OR {near_top}), false) AS s1_heavy_bear",
        "coalesce(_up AND rn > wave_start AND high > low AND (high - greatest(close, open)) / (high - low) > 0.618D "
        "AND pct_chg < 2 AND volume > _vmean * 1.5D AND volume >= _vmax * 0.99D, false) AS s1_windmill",
        f"coalesce(_up AND high >= _rh * 0.97D AND {real_bear} AND rn - wave_start >= 3 AND volume >= _vmax_prior * 0.99D "
        "AND (_high_close - open) / _high_close * 100 > 0 AND (_high_close - open) / _high_close * 100 < 3.82D, false) AS s1_second_high",
    )


def s1_scan_start(df: DataFrame) -> DataFrame:
    """First row of the distribution scan: the wave start, or the low close of the 120 rows before
    it while the wave is shorter than ten rows."""
    out = df.selectExpr(
        "*", f"min_by(rn, struct(close, rn)) {w.rows(120, 1)} AS _low_rn"
    )
    return out.selectExpr(
        "*", f"first(_low_rn) {w.running('code, wave_start')} AS _from"
    ).selectExpr(
        *df.columns, "CASE WHEN rn - wave_start + 1 < 10 THEN coalesce(_from, wave_start) ELSE wave_start END AS scan_from"
    )


def b2_signal(df: DataFrame) -> DataFrame:
    """A rise of 4% or more, no long upper shadow, volume 1.5x yesterday and 1.5x the prior five."""
    return df.selectExpr(
        "*",
        "coalesce((close - pc) / pc * 100 >= 4 AND close >= open AND high - close <= (close - open) * 1.2D "
        f"AND volume >= {w.ref('volume')} * 1.5D AND volume >= CASE WHEN rn >= 6 THEN avg(volume) {w.rows(5, 1)} "
        f"ELSE {w.ref('volume')} END * 1.5D, false) AS b2_signal",
    )


def b3_scan(
    df: DataFrame, prior_gain: float = 9.0, low: float = 2.0, high: float = 4.0, cap_min: float = 5e9,
    gap: float = 1.0, shadow: float = 2.0, vol_low: float = 0.6, vol_high: float = 0.9,
) -> DataFrame:
    """A small calm rise the session after a strong one; a null market cap passes."""
    out = df.selectExpr("*", f"{w.ref('pc')} AS _pc2", f"{w.ref('volume')} AS _pv")
    return out.selectExpr(
        *df.columns,
        f"coalesce((pc - _pc2) / _pc2 * 100 >= {prior_gain} AND (close - pc) / pc * 100 BETWEEN {low} AND {high} "
        f"AND close > open AND (open / pc - 1) * 100 < {gap} AND (high - close) / close * 100 <= {shadow} "
        f"AND (open - low) / open * 100 <= {shadow} AND volume / _pv BETWEEN {vol_low} AND {vol_high} "
        f"AND white_line > yellow_line AND close > yellow_line AND coalesce(market_cap > {cap_min}D, true), false) AS b3",
    )


def reversal_flags(df: DataFrame) -> DataFrame:
    """Failed rally against two rows earlier, up-spike with shadow, and the three-row distribution."""
    body_low = f"least({w.ref('open', 2)}, {w.ref('close', 2)})"
    return df.selectExpr(
        "*",
        f"coalesce(close < {body_low}, false) AS didi",
        "coalesce((close - pc) / pc * 100 > 3 AND (high - greatest(close, open)) / close * 100 > 2 "
        f"AND volume > avg(volume) {w.rows(3, 1)} * 1.2D AND rn >= 4, false) AS up_spike",
        f"coalesce(close < {w.ref('open', 2)}, false) AS distribution_3d",
    )


def bonus_points(df: DataFrame) -> DataFrame:
    """Points for a close near its 50-row low on volume, a DIF above its low, and rising slopes."""
    low = f"{w.llv('close', 50)}"
    return df.selectExpr(
        "*",
        f"CASE WHEN rn < 50 THEN 0 ELSE CASE WHEN close <= {low} * 1.02D AND volume > {w.llv('volume', 50)} * 1.1D THEN 5 ELSE 0 END"
        f" + CASE WHEN dif > {w.llv('dif', 50)} AND close <= {low} * 1.02D THEN 5 ELSE 0 END"
        f" + CASE WHEN {w.rolling_slope('close', 10)} > 1e-9D AND {w.rolling_slope('volume', 10)} > 1e-9D THEN 3 ELSE 0 END END AS bonus",
    )


def zone(x: str, ranges) -> str:
    """True inside any of the closed ranges."""
    return "(" + " OR ".join(f"{x} BETWEEN {lo} AND {hi}" for lo, hi in ranges) + ")"


def select_signals(
    df: DataFrame, j_max: float = 34, j_zones=None, cap_min: float = 4e9, max_shrink: float = 0.9, shrink_zones=None,
    near_pct: float = 3.5, check_double: bool = True, check_wave: bool = True, min_rows: int = 114,
) -> DataFrame:
    """Entry signals: trend and size gates, a qualified healthy wave, shrinking volume, position.

    ``j_zones`` and ``shrink_zones`` replace the plain thresholds when given.
    """
    gates = [
        f"rn >= {min_rows}",
        "white_gt_yellow",
        zone("J", j_zones) if j_zones else f"J < {j_max}",
        "dif > 0",
        f"market_cap >= {cap_min}D",
        "is_qualified AND wave_healthy" if check_wave else "shadow_ok",
        "wave_from IS NOT NULL",
        zone("vol_vs_wave_peak", shrink_zones) if shrink_zones else f"vol_vs_wave_peak < {max_shrink}D",
        f"(fall_in_bowl OR abs(close - white_line) / white_line <= {near_pct / 100!r}D OR is_washout)",
    ]
    if check_double:
        gates.append("NOT doubled")
    return df.filter(" AND ".join(f"({g})" for g in gates))
