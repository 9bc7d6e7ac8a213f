"""Exact quantiles, ranks and distribution distances of large groups.

Spark's exact ``percentile`` keeps every distinct value of a group in one task, and a rank over a
whole table is one task's work. Here the values of a group are first counted, then placed by the
running totals of coarse value buckets. No task holds a whole group, so one group may hold any share
of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Monotone coarse bucket of a value: 64 per e-fold of magnitude, down to e^-28, so that small values spread like large ones; NaN comes last.
_BUCKET = "CASE WHEN isnan(_v) THEN 2147483647 WHEN _v = 0 THEN 0 ELSE CAST(signum(_v) * greatest(0D, floor(least(1e6D, (ln(abs(_v)) + 28) * 64)) + 1) AS INT) END"


def cumulative_by_value(df: DataFrame, keys: Sequence[str], value: str, measures: dict[str, str]) -> DataFrame:
    """One row per (keys, value ``_v``) with each measure, its total ``t_`` and running total ``u_``.

    ``measures`` maps a name to an additive aggregate, for example ``count(1)``.
    """
    k = list(keys)
    by = ", ".join(k) or "1"
    counts = (
        df.filter(f"{value} IS NOT NULL")
        .groupBy(*k, F.expr(f"CAST({value} AS DOUBLE)").alias("_v"))
        .agg(*[F.expr(e).alias(m) for m, e in measures.items()])
        .selectExpr("*", f"{_BUCKET} AS _b")
    )
    before = f"OVER (PARTITION BY {by} ORDER BY _b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offsets = counts.groupBy(*k, "_b").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures]).selectExpr(
        *k,
        "_b",
        *[f"coalesce(sum(_s_{m}) {before}, 0) AS _o_{m}" for m in measures],
        *[f"sum(_s_{m}) OVER (PARTITION BY {by}) AS t_{m}" for m in measures],
    )
    inside = f"OVER (PARTITION BY {', '.join([*k, '_b'])} ORDER BY _v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return counts.join(offsets, [*k, "_b"]).selectExpr(
        *k, "_v", *measures, *[f"t_{m}" for m in measures], *[f"_o_{m} + sum({m}) {inside} AS u_{m}" for m in measures]
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """One row per key with the linearly interpolated quantiles ``wanted`` (name -> share)."""
    placed = cumulative_by_value(df, keys, value, {"n": "count(1)"})
    # Value at 0-based rank r is the one with upto - count <= r < upto.
    aggs = []
    for name, q in wanted.items():
        pos = f"(t_n - 1) * {q!r}D"
        for part, rank in (("lo", f"floor({pos})"), ("hi", f"ceil({pos})")):
            aggs.append(F.expr(f"max(CASE WHEN u_n - n <= {rank} AND {rank} < u_n THEN _v END)").alias(f"_{name}_{part}"))
    out = placed.groupBy(*keys).agg(F.max("t_n").alias("t_n"), *aggs)
    return out.selectExpr(
        *keys,
        *[f"_{n}_lo + (_{n}_hi - _{n}_lo) * ((t_n - 1) * {q!r}D - floor((t_n - 1) * {q!r}D)) AS {n}" for n, q in wanted.items()],
    )


def group_avg_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Average-tie rank of ``value`` in its group, for groups of any size. Null values are dropped."""
    placed = cumulative_by_value(df, keys, value, {"n": "count(1)"})
    ranks = placed.selectExpr(*keys, "_v", f"u_n - n + (n + 1) / 2D AS {out}")
    return df.selectExpr("*", f"CAST({value} AS DOUBLE) AS _v").join(ranks, [*keys, "_v"]).drop("_v")


def pair_spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, rows, spearman): rank correlation of two columns in groups of any size, over the rows that have both; null where one does not vary.

    Rows become counts of value pairs, and each side's ranks come from its value counts, so ties make the work smaller and no row is joined to
    its value. Mean ranks are known, so the correlation is a sum over the pairs.
    """
    k = list(keys)
    pairs = df.selectExpr(*k, f"CAST({x} AS DOUBLE) AS _x", f"CAST({y} AS DOUBLE) AS _y").filter("_x IS NOT NULL AND _y IS NOT NULL").groupBy(*k, "_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    joined = pairs
    for side in ("x", "y"):
        placed = cumulative_by_value(pairs, keys, f"_{side}", {"n": "sum(_n)"})
        joined = joined.join(placed.selectExpr(*k, f"_v AS _{side}", f"u_n - n + (n + 1) / 2D - (t_n + 1) / 2D AS _r{side}"), [*k, f"_{side}"])
    sums = joined.groupBy(*k).agg(F.sum("_n").alias("rows"), *[F.expr(f"sum(_n * _r{a} * _r{b})").alias(f"_{a}{b}") for a, b in ("xy", "xx", "yy")])
    return sums.selectExpr(*k, "rows", "try_divide(_xy, sqrt(_xx) * sqrt(_yy)) AS spearman")


def ks_distance(df: DataFrame, keys: Sequence[str], value: str, is_left: str) -> DataFrame:
    """Largest distance between the empirical distributions of the left rows and the others."""
    placed = cumulative_by_value(df, keys, value, {"a": f"count_if({is_left})", "b": f"count_if(NOT ({is_left}))"})
    return placed.groupBy(*keys).agg(
        F.max("t_a").alias("n_left"),
        F.max("t_b").alias("n_right"),
        F.expr("max(abs(try_divide(u_a, t_a) - try_divide(u_b, t_b)))").alias("ks"),
    )
