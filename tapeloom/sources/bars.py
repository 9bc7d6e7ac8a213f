"""Readers, normalisation, maintenance and listings of daily-bar tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import windows as w
from tapeloom.functions.scalars import normalize_code, strip_market_prefix

REQUIRED = ("open", "high", "low", "close", "volume")
NUMERIC = (*REQUIRED, "close_raw", "amount", "turnover", "market_cap", "change", "change_pct", "amplitude")
BAR_SCHEMA = "date STRING, " + ", ".join(f"{c} STRING" for c in NUMERIC)

# Asset policies: which gates apply to which asset type.
ASSET_POLICY = {
    "stock": {"name_filter": True, "cap_gate": True, "price_limits": True},
    "etf": {"name_filter": False, "cap_gate": False, "price_limits": False},
    "index": {"name_filter": False, "cap_gate": False, "price_limits": False},
}
SIGNAL_COLUMNS = (
    "code STRING, signal_date DATE, entry_date DATE, entry_price DOUBLE, exit_date DATE, exit_price DOUBLE, "
    "return_pct DOUBLE, hold_days INT, score DOUBLE"
)


def read_bars_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """One CSV per instrument, the code being the file name. Text columns; normalise afterwards.

    GBK needs ``spark.sql.legacy.javaCharsets=true`` in the session.
    """
    names = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1)
    raw = spark.read.schema(BAR_SCHEMA).option("header", True).option("encoding", encoding).option("enforceSchema", False).csv(path)
    return raw.select("*", names.alias("code")).selectExpr(f"{normalize_code('code')} AS code", "* EXCEPT (code)")


def read_bars_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Union by name over files whose columns drift."""
    return spark.read.option("mergeSchema", True).parquet(path)


def normalize_bars(df: DataFrame) -> DataFrame:
    """Dates and numbers by tolerant casts; rows without a date, prices or positive volume are dropped."""
    missing = [c for c in ("date", *REQUIRED) if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    casts = {c: f"try_cast({c} AS {'DATE' if c == 'date' else 'DOUBLE'}) AS {c}" for c in ("date", *NUMERIC)}
    out = df.selectExpr(*[casts.get(c, c) for c in df.columns])
    present = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in REQUIRED)
    return out.filter(f"date IS NOT NULL AND {present} AND volume > 0")


def upsert_bars(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (code, date); the new table wins. Both sides combine before the shuffle."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in ("code", "date", "_o")]
    return both.groupBy("code", "date").agg(F.max_by(F.struct(*cols), "_o").alias("r")).select("code", "date", "r.*")


def list_instruments(bars: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    keep = " OR ".join(f"startswith(code, '{p}')" for p in prefixes)
    return bars.filter(keep).select("code").distinct()


def selection_universe(stocks: DataFrame, etfs: DataFrame, history: DataFrame) -> DataFrame:
    """Stocks and eligible ETFs with an exchange, kept when they have any history."""
    exchange = "CASE WHEN substring(code, 1, 1) IN ('5', '6') THEN 'SH' ELSE 'SZ' END AS exchange"
    both = stocks.selectExpr("code", "'stock' AS asset_type", exchange).unionByName(
        etfs.filter("eligible").selectExpr("code", "'etf' AS asset_type", exchange)
    )
    return both.join(history.select("code").distinct(), "code", "left_semi")


def with_policy(df: DataFrame) -> DataFrame:
    """Policy flags of each row's asset type, as a literal map."""
    entries = ", ".join(
        f"'{k}', named_struct({', '.join(f'{chr(39)}{n}{chr(39)}, {str(v).lower()}' for n, v in p.items())})" for k, p in ASSET_POLICY.items()
    )
    return df.selectExpr("*", f"map({entries})[asset_type] AS _p").selectExpr(*df.columns, "_p.*")


def name_filter(df: DataFrame) -> DataFrame:
    """Drop delisted, unknown and special-treatment names where the policy says so."""
    return df.filter("NOT coalesce(name_filter, true) OR NOT (name RLIKE '退|未知' OR name RLIKE '^[*]?ST')")


def exact_session(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose date equals the wanted session of their code; no older row stands in."""
    return df.join(wanted.select("code", "date"), ["code", "date"], "left_semi")


def concept_bridge(raw: DataFrame, column: str = "payload") -> DataFrame:
    """(block, code) from JSON texts mapping block -> members; market prefixes are stripped."""
    return raw.selectExpr(f"explode(from_json({column}, 'MAP<STRING, ARRAY<STRING>>')) AS (block, members)").selectExpr(
        "block", "explode(members) AS m"
    ).selectExpr("block", f"{strip_market_prefix('m')} AS code").distinct()


def daily_returns(bars: DataFrame, cache: DataFrame | None = None, days: int = 60) -> DataFrame:
    """Percent returns of the latest ``days`` sessions merged over an older cache, one row per key."""
    rows = bars.selectExpr("code", "date", f"({w.pct_change('close')}) * 100 AS ret").filter("ret IS NOT NULL")
    cut = bars.select("date").distinct().orderBy(F.desc("date")).limit(days).agg(F.min("date")).scalar()
    recent = rows.filter(F.col("date") >= cut)
    return recent if cache is None else upsert_bars(cache, recent)


def drop_incomplete_bar(df: DataFrame, now: datetime) -> DataFrame:
    """Leave out the forming bar of today before the 15:00 close."""
    return df if now.hour >= 15 else df.filter(F.col("date") != F.lit(now.date()))


def paged_listing(bars: DataFrame, page: int, size: int) -> DataFrame:
    """Latest close and history length per code, one page in code order."""
    g = bars.groupBy("code").agg(F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close"), F.count(F.lit(1)).alias("sessions"))
    return g.orderBy("code").offset(page * size).limit(size)


def trading_calendar(bars: DataFrame, start: str, end: str) -> DataFrame:
    return bars.filter(f"date BETWEEN DATE'{start}' AND DATE'{end}'").select("date").distinct()


def universe_summary(bars: DataFrame, length: int = 2) -> DataFrame:
    return bars.select("code").distinct().groupBy(F.substring("code", 1, length).alias("prefix")).agg(F.count(F.lit(1)).alias("codes"))


def report_table(df: DataFrame, rows: str, columns: str, value: str, names: Sequence[str]) -> DataFrame:
    """Mean of a value per (row, column); the column names are given, so no extra job finds them."""
    return df.groupBy(rows).pivot(columns, list(names)).agg(F.avg(value))


def write_bars(df: DataFrame, path: str) -> None:
    """Yearly partitions, each written by several tasks; only the partitions present in ``df`` are replaced."""
    out = df.withColumn("year", F.year("date")).repartition("year", F.pmod(F.hash("code"), F.lit(16)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def write_signals(df: DataFrame, path: str) -> None:
    """Fixed columns in fixed order, also for no rows at all."""
    fields = [c.split()[0] for c in SIGNAL_COLUMNS.split(", ")]
    shaped = df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in fields])
    shaped.to(df.sparkSession.createDataFrame([], SIGNAL_COLUMNS).schema).write.mode("overwrite").option("header", True).csv(path)


def retain(spark: SparkSession, path: str, before: str, column: str = "date") -> DataFrame:
    """The rows to keep when partitions before a date are dropped; a partition filter, so they are not read."""
    return spark.read.parquet(path).filter(F.col(column) >= F.lit(before).cast("date"))
