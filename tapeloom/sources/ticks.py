"""Tick and order-book tables: normalisation, partitioned writes, range reads, feature store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICK_SCHEMA = (
    "time TIMESTAMP, price FLOAT, volume INT, amount DOUBLE, direction TINYINT, order_type TINYINT, seq BIGINT, code STRING"
)
# Provider direction codes to signed direction.
DIRECTIONS = {0: -1, 1: 1, 2: 0}


def normalize_ticks(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename provider columns, map directions, and fill amount and defaults."""
    out = df.withColumnsRenamed(names)
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in DIRECTIONS.items())
    keep = [c for c in out.columns if c not in ("direction", "amount", "volume")]
    amount = "coalesce(amount, price * volume)" if "amount" in out.columns else "price * volume"
    return out.selectExpr(*keep, "coalesce(volume, 0) AS volume", f"{amount} AS amount", f"CASE direction {cases} ELSE 0 END AS direction")


def write_ticks(df: DataFrame, path: str, files_per_day: int = 8) -> None:
    """Daily partitions. A day is spread over ``files_per_day`` tasks by a hash of the row, so no
    instrument's volume decides the size of a file."""
    out = df.withColumns({"date": F.to_date("time")})
    out.repartition("date", F.pmod(F.xxhash64("code", "seq"), F.lit(files_per_day))).sortWithinPartitions("code", "time").write.mode(
        "append"
    ).option("compression", "zstd").partitionBy("date").parquet(path)


def read_ticks(spark: SparkSession, path: str, start: str, end: str, codes=None) -> DataFrame:
    """Ticks of a closed date range; days are pruned as partitions, codes reach the scan."""
    out = spark.read.parquet(path).filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return out.filter(F.col("code").isin(*codes)) if codes else out


def append_order_book(df: DataFrame, path: str) -> None:
    df.withColumn("date", F.to_date("time")).write.mode("append").option("compression", "zstd").partitionBy("date").parquet(path)


def wide_to_levels(df: DataFrame, levels: int = 10) -> DataFrame:
    """Ten-level wide snapshots to one array of level structs."""
    entries = ", ".join(
        f"named_struct('level', {k}, " + ", ".join(f"'{c}', CAST({c}_{k:02d} AS DOUBLE)" for c in ("bid_price", "bid_volume", "ask_price", "ask_volume")) + ")"
        for k in range(1, levels + 1)
    )
    drop = {f"{c}_{k:02d}" for k in range(1, levels + 1) for c in ("bid_price", "bid_volume", "ask_price", "ask_volume")}
    return df.selectExpr(*[c for c in df.columns if c not in drop], f"array({entries}) AS levels")


def last_feature_days(features: DataFrame, n: int) -> DataFrame:
    """The latest ``n`` days of each code."""
    return features.selectExpr("*", "dense_rank() OVER (PARTITION BY code ORDER BY date DESC) AS _k").filter(f"_k <= {n}").drop("_k")
