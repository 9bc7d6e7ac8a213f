"""Factor panel: one row per instrument and session with factors and the next session's return."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tapeloom.functions import windows as w

FACTORS = ("vol_ratio", "mom5", "range_pct", "body_abs", "volume_rank", "atr_pct")


def factor_panel(bars: DataFrame) -> DataFrame:
    b = bars.selectExpr(
        "*",
        f"{w.ROW_INDEX} AS rn",
        f"{w.ref('close')} AS pc",
        f"{w.rolling_pct_rank('volume', 20)} AS volume_rank",
    )
    out = b.selectExpr(
        "code",
        "date",
        "rn",
        f"volume / {w.ma('volume', 20)} AS vol_ratio",
        f"{w.pct_change('close', 5)} AS mom5",
        "(high - low) / close AS range_pct",
        "abs(close - open) / open AS body_abs",
        "volume_rank",
        f"avg(greatest(high - low, abs(high - coalesce(pc, high)), abs(low - coalesce(pc, low)))) {w.rows(14)} / close AS atr_pct",
        "(high - low) / pc / (volume_rank + 1e-6D) AS range_efficiency",
        f"{w.lead('date')} AS exit_date",
        f"({w.lead('close')} / close - 1) * 100 AS return_pct",
    )
    return out.filter("return_pct IS NOT NULL").selectExpr("*", "date AS entry_date", "ln(1 + return_pct / 100) AS log_ret")
