"""Join shapes used across the analyses: as-of, checked lookup, interval, priority fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import cut_lineage


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    columns: Sequence[str],
    inclusive: bool = True,
    bucket: str | None = None,
) -> DataFrame:
    """For each left row, ``columns`` of the latest right row at or before its time.

    Both sides are united and read with one running window. With ``bucket`` (a ``date_trunc``
    unit) the window is split by (key, bucket), so one heavy key spreads over many tasks; the last
    right row of earlier buckets is carried into each bucket as one extra row.
    """
    payload = F.struct(F.col(right_time).alias("_at"), *columns)
    tie_right, tie_left = (0, 1) if inclusive else (1, 0)
    empty = right.select(payload.alias("_hit")).schema["_hit"].dataType
    l_rows = left.select(
        F.col(key).alias("_k"),
        F.col(left_time).alias("_t"),
        F.lit(tie_left).alias("_tie"),
        F.lit(None).cast(empty).alias("_hit"),
        F.struct(*left.columns).alias("_row"),
    )
    row_type = l_rows.schema["_row"].dataType
    r_rows = right.select(
        F.col(key).alias("_k"),
        F.col(right_time).alias("_t"),
        F.lit(tie_right).alias("_tie"),
        payload.alias("_hit"),
        F.lit(None).cast(row_type).alias("_row"),
    )
    keys = ["_k"]
    both = l_rows.unionByName(r_rows)
    if bucket:
        keys.append("_b")
        both = both.withColumn("_b", F.date_trunc(bucket, "_t"))
        per_bucket = both.groupBy("_k", "_b").agg(F.max(F.when(F.col("_hit").isNotNull(), F.struct("_t", "_hit"))).alias("_m"))
        before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carried = per_bucket.withColumn("_c", F.max("_m").over(before)).filter(F.col("_c").isNotNull())
        both = both.unionByName(
            carried.select(
                "_k", "_b", F.col("_c._t").alias("_t"), F.lit(-1).alias("_tie"), F.col("_c._hit").alias("_hit"),
                F.lit(None).cast(row_type).alias("_row"),
            )
        )
    running = Window.partitionBy(*keys).orderBy("_t", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_seen", F.last("_hit", ignorenulls=True).over(running)).filter(F.col("_row").isNotNull())
    return found.select(
        *[F.col(f"_row.{c}").alias(c) for c in left.columns],
        F.col("_seen._at").alias("asof_time"),
        *[F.col(f"_seen.{c}").alias(c) for c in columns],
    )


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str] | str, check: bool = True) -> DataFrame:
    """Left many-to-one join. With ``check``, a key repeated on the right fails the job."""
    keys = [on] if isinstance(on, str) else list(on)
    if check:
        single = Window.partitionBy(*keys)
        right = right.withColumn("_n", F.count(F.lit(1)).over(single)).select(
            *[c for c in right.columns if c not in keys],
            *[
                F.when(F.assert_true(F.col("_n") == 1, F.lit("lookup key is not unique")).isNull(), F.col(k)).alias(k)
                for k in keys
            ],
        )
    return left.join(right, keys, "left")


def explode_days(df: DataFrame, start: str, end: str, day: str = "day", business: bool = True) -> DataFrame:
    """One row per calendar day of [start, end]; weekdays only with ``business``.

    Turns an interval join on days into an equi-join.
    """
    days = df.filter(F.col(end) >= F.col(start)).withColumn(day, F.explode(F.sequence(F.col(start), F.col(end))))
    return days.filter(F.weekday(day) < 5) if business else days


def near_rows(left: DataFrame, right: DataFrame, key: str, left_pos: str, right_pos: str, reach: int) -> DataFrame:
    """Pairs with the same key and integer positions at most ``reach`` apart, as an equi-join.

    The right side is copied to each position it can reach, 2*reach+1 copies, so no range scan and
    no pairs outside the band are made.
    """
    spread = right.withColumn("_pos", F.explode(F.sequence(F.col(right_pos) - reach, F.col(right_pos) + reach)))
    return left.join(spread, (left[key] == spread[key]) & (left[left_pos] == spread["_pos"])).drop(spread[key]).drop("_pos")


def first_valid(base: str, sources: Sequence[tuple[Column, Column]]) -> Column:
    """``base`` if present, else the first source value whose validity test passes."""
    return F.coalesce(F.col(base), *[F.when(valid, value) for value, valid in sources])


# Fixed value: rows of (block, day) up to which the shares are sent to every task.
SENT_SHARES = 2_000_000


def concept_resonance(signals: DataFrame, bridge: DataFrame, reach: int = 2) -> DataFrame:
    """Largest share of a block's members that signal within ``reach`` days of each signal.

    The days that a member's signals reach are united into islands first, so each member counts once a day; the count per
    (block, day) is a running sum of islands begun and ended, which combine on the map side. Neither days nor pairs of
    signals are formed per member, and signals meet their blocks without a shuffle of their product. Signals and ``bridge``
    are read twice and stored.
    """
    bridge = cut_lineage(bridge.select("block", "code"))
    sizes = bridge.groupBy("block").agg(F.count(F.lit(1)).alias("members"))
    rows = cut_lineage(signals.select("code", "date").distinct())
    order = "OVER (PARTITION BY code ORDER BY date)"
    ends = rows.selectExpr(
        "code", "date",
        f"coalesce(datediff(date, lag(date) {order}) > {2 * reach + 1}, true) AS _first", f"coalesce(datediff(lead(date) {order}, date) > {2 * reach + 1}, true) AS _last",
    ).selectExpr(
        "code",
        f"explode(filter(array(CASE WHEN _first THEN struct(date_sub(date, {reach}) AS day, 1L AS step) END, CASE WHEN _last THEN struct(date_add(date, {reach + 1}) AS day, -1L AS step) END), e -> e IS NOT NULL)) AS e",
    )
    members = bridge.select("block", "code").distinct()
    steps = ends.join(members, "code").groupBy("block", "e.day").agg(F.sum("e.step").alias("step"))
    # From here on one row per block and day.
    by_day = "OVER (PARTITION BY block ORDER BY day)"
    near = steps.selectExpr("block", "day", f"sum(step) {by_day} AS near", f"lead(day) {by_day} AS _next").filter("near > 0")
    shares = near.join(sizes, "block").selectExpr("block", "explode(sequence(day, date_sub(_next, 1))) AS date", "near / members AS share")
    shares = cut_lineage(shares)
    if shares.count() <= SENT_SHARES:
        shares = F.broadcast(shares)
    return rows.join(bridge, "code").join(shares, ["block", "date"]).groupBy("code", "date").agg(F.max("share").alias("resonance"))
