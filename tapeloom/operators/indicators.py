"""Technical indicators: one column each, computed per instrument in date order.

``add_indicators`` produces the shared indicator table. All recurrences are stepped in one pass and all
frames use the same partitioning, so the whole table costs one exchange by ``code``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tapeloom.functions import windows as w
from tapeloom.functions.recurrence import add_recurrences, add_steps, ema

YELLOW_SPANS = (14, 28, 57, 114)
MA_SPANS = (5, 10, 20, 30, 40, 60)


def _ema(x: str, before: str, span: int) -> str:
    return f"{2 / (span + 1)}D * {x} + {(span - 1) / (span + 1)}D * {before}"


# Steps of the series that others are formed of. K and D can tie exactly (two rows after a lone pulse), so each is taken as it is defined.
_E10, _E12, _E26 = (_ema("x.close", f"p._e{n}", n) for n in (10, 12, 26))
_K = "x._rsv / 3D + p.K * 2 / 3D"
_S4 = "(x._v3 + 5 * p._s4) / 6D"


def yellow_line(x: str = "close", spans=YELLOW_SPANS) -> str:
    """Mean of the moving averages over ``spans``."""
    return f"({' + '.join(w.ma(x, n) for n in spans)}) / {len(spans)}"


def double_line(df: DataFrame) -> DataFrame:
    """White line (double EMA of 10) and yellow line only."""
    out = add_recurrences(df, [ema("_e", "close", 10)])
    out = add_recurrences(out, [ema("white_line", "_e", 10)]).drop("_e")
    return out.selectExpr("*", f"{yellow_line()} AS yellow_line")


def add_indicators(df: DataFrame) -> DataFrame:
    """White, yellow, KDJ, MACD, moving averages, brick and smoothed RSI on ascending bars.

    KDJ uses the range of up to nine rows; K and D start at their first input. Also adds the row
    number ``rn`` and the previous close ``pc``.
    """
    out = df.selectExpr(
        "*",
        f"{w.ROW_INDEX} AS rn",
        f"{w.ref('close')} AS pc",
        f"{w.hhv('high', 9)} AS _h9",
        f"{w.llv('low', 9)} AS _l9",
        f"{w.hhv('high', 4)} AS _h4",
        f"{w.llv('low', 4)} AS _l4",
    ).selectExpr(
        "*",
        "CASE WHEN _h9 > _l9 THEN 100 * (close - _l9) / (_h9 - _l9) ELSE 0D END AS _rsv",
        "CASE WHEN _h4 <> _l4 THEN _h4 - _l4 ELSE 1e-9D END AS _d4",
        "greatest(close - coalesce(pc, close), 0D) AS _gain",
        "greatest(coalesce(pc, close) - close, 0D) AS _loss",
    )
    out = add_steps(
        out.selectExpr("*", "(_h4 - close) / _d4 * 100D - 90D AS _v1", "(close - _l4) / _d4 * 100D AS _v3"),
        {
            "_e10": ("x.close", _E10),
            "white_line": ("x.close", f"{2 / 11}D * ({_E10}) + {9 / 11}D * p.white_line"),
            "_e12": ("x.close", _E12),
            "_e26": ("x.close", _E26),
            "dea": ("0D", f"0.2D * ({_E12} - ({_E26})) + 0.8D * p.dea"),
            "K": ("x._rsv", _K),
            "D": ("x._rsv", f"({_K}) / 3D + p.D * 2 / 3D"),
            "_s2": ("x._v1", "(x._v1 + 3 * p._s2) / 4D"),
            "_s4": ("x._v3", _S4),
            "_s5": ("x._v3", f"({_S4} + 5 * p._s5) / 6D"),
            **{f"_{to}{n}": (f"x._{of}", _ema(f"x._{of}", f"p._{to}{n}", n)) for n in (6, 14) for to, of in (("g", "gain"), ("f", "loss"))},
        },
    )
    return out.selectExpr(
        *df.columns,
        "rn",
        "pc",
        "K",
        "D",
        "3 * K - 2 * D AS J",
        "white_line",
        "_e12 - _e26 AS dif",
        "dea",
        "2 * (_e12 - _e26 - dea) AS macd",
        "greatest(_s5 + 100 - (_s2 + 100) - 4, 0D) AS brick",
        *[f"100 - 100 / (1 + _g{n} / CASE WHEN _f{n} = 0 THEN 1e-9D ELSE _f{n} END) AS rsi_{n}" for n in (6, 14)],
        f"{yellow_line()} AS yellow_line",
        *[f"{w.ma('close', n)} AS ma{n}" for n in MA_SPANS],
    )


def position_flags(df: DataFrame, shrink_ratio: float = 0.9, near_pct: float = 3.5) -> DataFrame:
    """Volume shrink, bowl, nearness and the 60-row doubling test."""
    near = f"{near_pct / 100.0}D"
    return df.selectExpr(
        "*",
        f"volume < {w.hhv('volume', 20)} * {shrink_ratio}D AS volume_shrink",
        "white_line > yellow_line AS white_gt_yellow",
        "close >= yellow_line AND close <= white_line AS fall_in_bowl",
        f"close >= yellow_line AND (close - yellow_line) / yellow_line <= {near} AS near_yellow",
        f"abs(close - white_line) / white_line <= {near} AS near_white",
        f"{w.hhv('high', 60)} > {w.llv('low', 60)} * 2D AS doubled",
    )


def brick_signal(df: DataFrame, height_ratio: float = 2.0 / 3.0) -> DataFrame:
    """A rising brick after a falling one, tall enough, with the close above the yellow line."""
    return df.selectExpr(
        "*", f"{w.diff('brick')} AS red_height", f"{w.ref('brick', 2)} - {w.ref('brick')} AS green_height"
    ).selectExpr(
        "*",
        f"coalesce(green_height > 0 AND red_height > 0 AND red_height >= green_height * {height_ratio}D "
        "AND close > yellow_line, false) AS brick_signal",
    )


# --- single indicators, as expressions over bars with ``pc`` -----------------------------------

_STEP = "coalesce(close - pc, 0D)"


def rsi_simple(n: int = 14) -> str:
    """Mean gain against mean loss over ``n`` full steps; 100 without losses, 50 without moves."""
    gain = f"avg(CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0D) END) {w.rows(n)}"
    loss = f"avg(CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0D) END) {w.rows(n)}"
    return (
        f"CASE WHEN count(pc) {w.rows(n)} < {n} THEN NULL WHEN {loss} = 0 AND {gain} > 0 THEN 100D "
        f"WHEN {loss} = 0 THEN 50D ELSE 100 - 100 / (1 + {gain} / {loss}) END"
    )


def rsi_sum(n: int = 14, skip: int = 0) -> str:
    """Sum of gains against sum of losses over ``n`` steps; a loss under 0.001 counts as 0.001."""
    gain = f"sum(greatest({_STEP}, 0D)) {w.rows(n, skip)}"
    loss = f"sum(greatest(-{_STEP}, 0D)) {w.rows(n, skip)}"
    return f"100 - 100 / (1 + {gain} / greatest({loss}, 0.001D))"


def bollinger_b(n: int = 20, ddof: int = 1) -> str:
    """Position of the close between the two-sigma bands; 0.5 for a flat band."""
    mean, std = w.ma("close", n), w.rolling_std("close", n, ddof)
    return f"CASE WHEN {std} > 0 THEN (close - ({mean} - 2 * {std})) / (4 * {std}) ELSE 0.5D END"


def williams_r(n: int = 14, positive: bool = False) -> str:
    high, low = w.hhv("high", n), w.llv("low", n)
    sign = 100.0 if positive else -100.0
    return f"CASE WHEN {high} > {low} THEN ({high} - close) / ({high} - {low}) * {sign}D ELSE {sign / 2}D END"


def obv() -> str:
    """Cumulative volume signed by the close-to-close direction."""
    return f"sum(sign({_STEP}) * volume) {w.SO_FAR}"


def true_range(terms: int = 3) -> str:
    """Range of the row and its distance to the previous close, with two or three terms."""
    third = ", abs(low - pc)" if terms == 3 else ""
    return f"CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc){third}) END"


def momentum_columns(df: DataFrame) -> DataFrame:
    """The indicator columns used as brick features: bands, W%R, OBV, ATR, returns, ratios."""
    bull = "CASE WHEN close > pc THEN 1D ELSE 0D END"
    return (
        df.selectExpr("*", f"{obv()} AS obv", f"{true_range(2)} AS tr", "close / pc - 1 AS _ret")
        .selectExpr(
            *df.columns,
            "obv",
            "tr",
            f"{bollinger_b()} AS bb_pct_b",
            f"{williams_r()} AS wr_14",
            f"{w.ma('obv', 5)} AS obv_ma5",
            f"{w.ma('tr', 10)} AS atr_10",
            f"{w.ma('tr', 20)} AS atr_20",
            f"{w.rolling_std('_ret', 10)} * 100 AS std_ret_10d",
            *[f"{w.pct_change('close', n)} * 100 AS ret_{n}d" for n in (5, 10, 20, 60)],
            f"avg({bull}) {w.rows(5)} AS bullish_ratio_5d",
            f"avg({bull}) {w.rows(10)} AS bullish_ratio_10d",
            f"close = {w.hhv('high', 20)} AS new_high_20d",
            f"{w.ma('volume', 5)} AS vol_ma5",
            f"{w.ma('volume', 20)} AS vol_ma20",
            f"{w.ma('turnover', 5)} AS turnover_ma5",
            f"{w.ma('turnover', 20)} AS turnover_ma20",
            f"{w.hhv('turnover', 60)} AS turnover_max60",
            f"coalesce(macd > {w.ref('macd', 3)}, false) AS macd_hist_rising",
        )
        .selectExpr("*", "obv > obv_ma5 AS obv_trend_up")
    )
