"""Brick signal features, run-length state, two-leg bottoms and entry features."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tapeloom.functions import windows as w
from tapeloom.functions.scalars import change, limit_pct

# The features scored at a brick signal.
FEATURES = (
    "red_height brick_slope_3d brick_slope_5d brick_value red_green_ratio rsi_6 rsi_14 bb_pct_b wr_14 "
    "close_to_yellow_pct close_to_ma5_pct close_to_ma10_pct close_to_ma20_pct close_to_ma60_pct close_to_white_pct "
    "ret_5d ret_10d bullish_ratio_5d bullish_ratio_10d new_high_20d obv_trend_up vol_ratio_5 macd_hist_rising "
    "turnover_ratio_5 vol_ratio_20"
).split()


def limit_flags(df: DataFrame) -> DataFrame:
    """One-word limit-up and limit-down bars, and an open at the upper limit."""
    move, flat = change("close", "pc"), "abs(open - close) / pc < 0.001D"
    return df.selectExpr("*", f"{limit_pct()} AS _lim").selectExpr(
        *df.columns,
        f"coalesce(pc > 0 AND {move} >= _lim * 0.99D AND {flat}, false) AS one_word_up",
        f"coalesce(pc > 0 AND {move} <= -_lim * 0.99D AND {flat}, false) AS one_word_down",
        f"coalesce(pc > 0 AND {change('open', 'pc')} >= _lim * 0.99D, false) AS open_limit_up",
    )


def signal_features(df: DataFrame) -> DataFrame:
    """Feature columns of every row; needs the brick and momentum columns."""

    def gap(x: str, name: str) -> str:
        return f"CASE WHEN {x} > 0 THEN (close - {x}) / {x} * 100 ELSE 0D END AS close_to_{name}_pct"

    first = f"first(brick) {w.SO_FAR}"
    return df.selectExpr(
        "*",
        *[f"(brick - coalesce({w.ref('brick', n)}, {first})) / {n} AS brick_slope_{n}d" for n in (3, 5)],
        "brick AS brick_value",
        "red_height / greatest(abs(green_height), 1e-6D) AS red_green_ratio",
        gap("yellow_line", "yellow"),
        gap("white_line", "white"),
        *[gap(f"ma{n}", f"ma{n}") for n in (5, 10, 20, 60)],
        "volume / greatest(vol_ma5, 1D) AS vol_ratio_5",
        "volume / greatest(vol_ma20, 1D) AS vol_ratio_20",
        "turnover / greatest(turnover_ma5, 1e-6D) AS turnover_ratio_5",
        f"{w.safe_div('turnover', 'turnover_ma20', '0D')} AS turnover_ratio_20",
        f"{w.safe_div('turnover', 'turnover_max60', '0D')} AS turnover_to_60d_max",
        f"volume / {w.hhv('volume', 60)} AS volume_to_60d_max",
    ).selectExpr(
        "*",
        f"0.5D * {w.clip('turnover_ratio_20 / 2', 0, 1)} + 0.3D * {w.clip('turnover_to_60d_max', 0, 1)} "
        f"+ 0.2D * {w.clip('volume_to_60d_max', 0, 1)} AS turnover_extreme_score",
    )


def entry_features(df: DataFrame, source: str = "t1") -> DataFrame:
    """Gap and distance of the next open to yellow and MA5.

    ``t0`` uses the averages of the signal row. ``t1`` uses the next row's averages with its close
    replaced by its open, so nothing after the open is read.
    """
    share = (1 / 14 + 1 / 28 + 1 / 57 + 1 / 114) / 4
    out = df.selectExpr(
        "*",
        f"coalesce({w.lead('open')}, open) AS _o",
        f"coalesce({w.lead('open')}, open) - coalesce({w.lead('close')}, close) AS _d",
        f"coalesce({w.lead('yellow_line')}, yellow_line) AS _y",
        f"coalesce({w.lead('ma5')}, ma5) AS _m",
    )
    yellow, ma5 = ("yellow_line", "ma5") if source == "t0" else (f"(_y + _d * {share!r}D)", "(_m + _d / 5)")
    return out.selectExpr(
        *df.columns,
        "(_o - close) / close * 100 AS overnight_gap_pct",
        f"(_o - {yellow}) / {yellow} * 100 AS entry_open_to_yellow_pct",
        f"(_o - {ma5}) / {ma5} * 100 AS entry_open_to_ma5_pct",
    )


def sequence_state(df: DataFrame) -> DataFrame:
    """Colour and run state of the brick series. A zero move neither breaks nor extends a run."""
    out = df.selectExpr("*", f"CAST(sign({w.diff('brick')}) AS DOUBLE) AS color", f"abs({w.diff('brick')}) AS brick_height")
    out = out.selectExpr("*", f"last(nullif(color, 0D), true) {w.BEFORE} AS _prev")
    out = out.selectExpr("*", "coalesce(color <> 0 AND (_prev IS NULL OR _prev <> color), false) AS _start")
    out = out.selectExpr("*", f"count_if(_start) {w.SO_FAR} AS _run")
    in_run = w.running("code, _run")
    out = out.selectExpr("*", f"CASE WHEN color <> 0 THEN count_if(color <> 0) {in_run} END AS _pos")
    out = out.selectExpr("*", f"CASE WHEN _start THEN last(_pos, true) {w.BEFORE} END AS _done")
    return out.selectExpr(
        *df.columns,
        "color",
        "brick_height",
        "_pos - 1 AS same_color_exclusive",
        "_pos AS reversal_recency",
        f"CASE WHEN color <> 0 THEN last(_done, true) {in_run} END AS prior_run_length",
    ).selectExpr("*", "reversal_recency / prior_run_length AS run_length_ratio")


def w_bottom(df: DataFrame, lookbacks=(5, 10), min_down: float = 0.001, rows: str = "true") -> DataFrame:
    """Two falling legs with a rebound between: contraction of volume and time, retest quality.

    ``rows`` restricts the evaluation to signal rows, after the frames are formed. Bars of the
    frame are numbered from 1; leg one spans bars s1..e1 and the last leg s2..e2.
    """
    out = df.selectExpr("*", f"collect_list(struct(close, low, volume)) {w.rows(max(lookbacks))} AS _win").filter(rows)
    keep = list(df.columns)

    def part(a: str, b: str) -> str:
        return f"slice(_w, {a}, greatest({b} - ({a}) + 1, 0))"

    def mean_volume(a: str, b: str) -> str:
        return f"aggregate({part(a, b)}, 0D, (s, x) -> s + x.volume) / size({part(a, b)})"

    for n in lookbacks:
        out = out.selectExpr(*keep, "_win", f"CASE WHEN size(_win) > {n} THEN slice(_win, -{n}, {n}) ELSE _win END AS _w")
        out = out.selectExpr(
            "*",
            "CASE WHEN size(_w) >= 4 THEN transform(sequence(2, size(_w)), "
            f"j -> _w[j - 1].close / _w[j - 2].close - 1 < -{min_down}D) END AS _dn",
        )
        out = out.selectExpr(
            "*",
            "CAST(nullif(array_position(_dn, true), 0) AS INT) AS _s1",
            "CAST(size(_w) - nullif(array_position(reverse(_dn), true), 0) + 1 AS INT) AS _e2",
        )
        # The first false at or after s1 ends leg one; the last false before e2 starts the last leg.
        out = out.selectExpr(
            "*",
            "coalesce(array_min(filter(sequence(1, size(_dn)), j -> j > _s1 AND NOT _dn[j - 1])), size(_w)) AS _e1",
            "coalesce(array_max(filter(sequence(1, size(_dn)), j -> j < _e2 - 1 AND NOT _dn[j - 1])) + 1, 1) AS _s2",
        )
        out = out.selectExpr(
            "*",
            "coalesce(_s2 > _e1 AND array_max(transform("
            + part("_e1", "_s2")
            + ", x -> x.close)) / _w[_e1 - 1].close - 1 > 0.002D, false) AS _ok",
        )
        out = out.selectExpr(
            "*",
            f"CASE WHEN _ok THEN {mean_volume('_s1 + 1', '_e1')} END AS _v1",
            f"CASE WHEN _ok THEN {mean_volume('_s2 + 1', '_e2')} END AS _v2",
            "_e1 - _s1 AS _t1",
            "_e2 - _s2 AS _t2",
            "CASE WHEN _ok THEN greatest(-1D, least(1D, 1 - abs(_w[_e2 - 1].low - _w[_e1 - 1].low) "
            "/ greatest(abs(_w[size(_w) - 1].close), 1e-6D))) END AS _q",
        )
        share = "(0.5D + CASE WHEN _v2 <= _v1 THEN 0.25D ELSE 0D END + CASE WHEN _t2 <= _t1 THEN 0.25D ELSE 0D END)"
        measures = {
            "presence": "1D",
            "volume_contraction": "ln((_v1 + 1) / (_v2 + 1))",
            "time_contraction": "ln((_t1 + 1) / (_t2 + 1))",
            "retest_quality": "_q",
            "score": f"greatest(ln((_v1 + 1) / (_v2 + 1)), 0D) * {share} * greatest(_q, 0D)",
        }
        out = out.selectExpr(
            *keep, "_win", *[f"CASE WHEN _ok THEN {e} ELSE 0D END AS wbottom_{m}_{n}d" for m, e in measures.items()]
        )
        keep += [f"wbottom_{m}_{n}d" for m in measures]
    return out.selectExpr(*keep, "0.6D * wbottom_score_5d + 0.4D * wbottom_score_10d AS exhaustion_score")
