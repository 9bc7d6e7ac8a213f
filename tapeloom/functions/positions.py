"""Row positions, prefix sums and sliding frames over groups too large for one task.

A group is cut into blocks (minutes, hours, days: any expression that grows with the order).
Counts and sums per block are combined on the map side; their running totals are one short list per
group. Row work then runs per (group, block), so a group with a third of all rows is spread over
as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_positions(
    df: DataFrame, keys: Sequence[str], block: str, order: str, sums: dict[str, str] | None = None
) -> DataFrame:
    """Add the 0-based position ``pos`` in the group, the group size ``size``, and running sums.

    ``sums`` maps a column name to the expression it accumulates in order.
    """
    sums = sums or {}
    k = ", ".join(keys)
    rows = df.selectExpr("*", f"{block} AS _blk")
    per_block = rows.groupBy(*keys, "_blk").agg(
        F.count(F.lit(1)).alias("_n"), *[F.expr(f"sum({e})").alias(f"_s_{c}") for c, e in sums.items()]
    )
    before = f"OVER (PARTITION BY {k} ORDER BY _blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offsets = per_block.selectExpr(
        *keys,
        "_blk",
        f"coalesce(sum(_n) {before}, 0) AS _off",
        f"sum(_n) OVER (PARTITION BY {k}) AS size",
        *[f"coalesce(sum(_s_{c}) {before}, 0) AS _o_{c}" for c in sums],
    )
    inside = f"OVER (PARTITION BY {k}, _blk ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return rows.join(offsets, [*keys, "_blk"]).selectExpr(
        *df.columns,
        f"_off + count(1) {inside} - 1 AS pos",
        "size",
        *[f"_o_{c} + sum({e}) {inside} AS {c}" for c, e in sums.items()],
    )


def sliding(df: DataFrame, keys: Sequence[str], width: int, columns: dict[str, str], chunk: int = 4096) -> DataFrame:
    """Aggregates over the last ``width`` rows by position, exact across chunk borders.

    ``columns`` maps a name to an aggregate. The last ``width - 1`` rows of a chunk are copied to
    the next one, read there by the frames, and dropped.
    """
    k = ", ".join(keys)
    home = f"CAST(floor(pos / {chunk}) AS BIGINT)"
    spread = df.selectExpr("*", f"explode(sequence({home}, CAST(floor((pos + {width - 1}) / {chunk}) AS BIGINT))) AS _ch")
    frame = f"OVER (PARTITION BY {k}, _ch ORDER BY pos ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    return (
        spread.selectExpr("*", *[f"{e} {frame} AS {c}" for c, e in columns.items()])
        .filter(f"_ch = {home}")
        .drop("_ch")
    )
