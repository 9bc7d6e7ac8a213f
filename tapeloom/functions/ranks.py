"""The three rank conventions and top-N by group.

Each is exact. Cross-section windows are partitioned by session (plus a group where stated), so a
partition holds at most one row per instrument.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _by(by: str | Sequence[str]) -> str:
    return by if isinstance(by, str) else ", ".join(by)


def avg_rank(x: str, by: str | Sequence[str], descending: bool = False) -> str:
    """Average-tie rank (1-based), null for null.

    The lowest rank of a tie and the number of rows up to it read the same sorted window.
    """
    order = f"PARTITION BY {_by(by)} ORDER BY {x} {'DESC' if descending else 'ASC'} NULLS LAST"
    upto = f"count(1) OVER ({order} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({order}) + {upto}) / 2D END"


def pct_rank_avg(x: str, by: str | Sequence[str], default: float | None = None, descending: bool = False) -> str:
    """Average-tie rank divided by the number of non-null values; nulls get ``default``."""
    ranked = f"{avg_rank(x, by, descending)} / count({x}) OVER (PARTITION BY {_by(by)})"
    return ranked if default is None else f"coalesce({ranked}, {default}D)"


def pct_better(x: str, by: str | Sequence[str], lower_is_better: bool = False, min_rows: int = 3) -> str:
    """Share of the group strictly beaten by this row, x100; 50 for groups under ``min_rows``.

    With ``lower_is_better`` a row beats those with a strictly greater value.
    """
    order = f"PARTITION BY {_by(by)} ORDER BY {x} {'DESC' if lower_is_better else 'ASC'}"
    seen = f"count(1) OVER (PARTITION BY {_by(by)})"
    return f"CASE WHEN {seen} < {min_rows} THEN 50D ELSE (rank() OVER ({order}) - 1) * 100D / {seen} END"


def order_rank(by: str | Sequence[str], order: str) -> str:
    return f"row_number() OVER (PARTITION BY {_by(by)} ORDER BY {order})"


def top_n(df: DataFrame, n: int, by: str | Sequence[str], order: str, rank_col: str = "rank") -> DataFrame:
    """The first ``n`` rows per group under a total order.

    Spark prunes each map task's group to ``n`` rows before the exchange (WindowGroupLimit), so a
    large group does not travel whole.
    """
    return df.withColumn(rank_col, F.expr(order_rank(by, order))).filter(f"{rank_col} <= {n}")


def top_n_group_cap(
    df: DataFrame, n: int, per_group: int, by: str, group: str, order: str, rank_col: str = "rank"
) -> DataFrame:
    """Greedy pick of ``n`` rows per ``by`` with at most ``per_group`` from one ``group``.

    Taking rows in order and skipping full groups keeps exactly the first ``per_group`` rows of
    each group, so two ranks give the greedy result.
    """
    capped = top_n(df, per_group, [by, group], order, "_in_group").drop("_in_group")
    return top_n(capped, n, by, order, rank_col)


def long_ranks(df: DataFrame, features: Sequence[str], keys: Sequence[str], by: str, rank: str) -> DataFrame:
    """(keys, feature, value, rank, row): one row per input row and feature, ranked in its session.

    Ranking features as rows needs one sorted window instead of one per feature, and spreads a
    session over as many tasks as there are features. The input row travels once, on its first
    feature row, and is null elsewhere. ``rank`` is an expression over ``value``.
    """
    entries = ", ".join(f"struct('{f}' AS feature, CAST({f} AS DOUBLE) AS value)" for f in features)
    long = df.selectExpr(*keys, "struct(*) AS _all", f"posexplode(array({entries})) AS (_pos, _e)").selectExpr(
        *keys, "CASE WHEN _pos = 0 THEN _all END AS row", "_e.feature AS feature", "_e.value AS value"
    )
    return long.withColumn("rank", F.expr(rank.format(by=f"{by}, feature")))


# Ranked values and input rows of a partition, where the number of rows is known: what a task sorts does not grow with the input.
VALUES_PER_PARTITION = 1_000_000
ROWS_PER_PARTITION = 100_000


def partitions(df: DataFrame, rows: int, each: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each))


# Coarse bucket of a value, monotone in it: sixteen per e-fold of magnitude; nulls come first.
_BUCKET = "coalesce(CAST(signum(value) * floor(ln(1 + abs(value)) * 16) AS INT), -2147483648)"


def value_ranks(df: DataFrame, features: dict[str, str], keys: Sequence[str], by: str, rows: int | None = None) -> DataFrame:
    """(keys, feature, value, below, upto, nulls, rows): one row per input row and feature of ``features`` (name -> expression).

    ``below`` and ``upto`` count the rows of the session with a smaller, and with a smaller or equal value, nulls first;
    ``nulls`` and ``rows`` count those without a value, and all. A session is not
    one window: values are ranked inside coarse value buckets, whose offsets come from bucket counts combined on the map
    side. Only keys and values travel. With the number of ``rows`` of ``df``, partitions grow with it; else they are the session's.
    """
    entries = ", ".join(f"struct('{f}' AS feature, CAST({x} AS DOUBLE) AS value)" for f, x in features.items())
    long = df.selectExpr(*keys, f"inline(array({entries}))").selectExpr("*", f"{_BUCKET} AS _b")
    before = f"OVER (PARTITION BY {by}, feature ORDER BY _b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offsets = long.groupBy(by, "feature", "_b").agg(F.count(F.lit(1)).alias("_n")).selectExpr(
        by, "feature", "_b", f"coalesce(sum(_n) {before}, 0) AS _o", f"sum(_n) OVER (PARTITION BY {by}, feature) AS rows",
        f"coalesce(sum(CASE WHEN _b = -2147483648 THEN _n END) OVER (PARTITION BY {by}, feature), 0) AS nulls",
    )
    if rows is not None:
        n = partitions(df, rows * len(features), VALUES_PER_PARTITION)
        long, offsets = (x.repartition(n, by, "feature", "_b") for x in (long, offsets))
    inside = f"OVER (PARTITION BY {by}, feature, _b ORDER BY value"
    return long.join(offsets, [by, "feature", "_b"]).selectExpr(
        *keys, "feature", "value", f"_o + rank() {inside}) - 1 AS below",
        f"_o + count(1) {inside} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto", "nulls", "rows",
    )


# Average-tie rank as a share of the rows with a value, over the columns of ``value_ranks``; null for null.
AVERAGE_SHARE = "CASE WHEN value IS NOT NULL THEN (below + upto + 1 - 2 * nulls) / 2D / (rows - nulls) END"


def wide_ranks(df: DataFrame, features: dict[str, str], keys: Sequence[str], by: str, rank: str) -> DataFrame:
    """``df`` with a column for each feature: ``rank`` over ``below`` and ``rows``. ``keys`` (with ``by``) name a row; ``df`` is
    read three times and should be stored."""
    long = value_ranks(df, features, keys, by).selectExpr(*keys, "feature", f"{rank} AS _r")
    wide = long.groupBy(*keys).agg(*[F.max(F.expr(f"CASE WHEN feature = '{f}' THEN _r END")).alias(f) for f in features])
    return df.join(wide, list(keys))
