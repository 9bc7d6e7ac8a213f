"""Adapters that shape order, event and document tables into market inputs.

Bars are built with one aggregation keyed by (instrument, session): every aggregate combines on
the map side, so an instrument holding a third of the rows still sends one row per map task and
session through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.scalars import normalize_code


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Line items for each partition of instruments: their bars and all columns made of them fit one task's share of memory.
ITEMS_PER_PARTITION = 128_000


def instrument_partitions(items: DataFrame) -> int:
    """Partitions of bars by instrument: they grow with the line items, which are counted from the file footers, and keep every core busy."""
    return max(items.sparkSession.sparkContext.defaultParallelism, -(-items.count() // ITEMS_PER_PARTITION))


def bars(spark: SparkSession, folder: str, session: str = "week") -> DataFrame:
    """One bar per supplier and session from line items, dealt by instrument into partitions of bounded size.

    All windows of an instrument use that partitioning. Left to the session's setting, the rows of a partition would grow with the input.
    Price is ``extendedprice / quantity``; open and close are the first and last print in the full
    column order, because order key and line number alone repeat.
    """
    # The JVM does not compile methods beyond 8,000 bytes of code: rows of dozens of columns would run interpreted in one of them.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    items = table(spark, folder, "lineitem")
    order = F.struct(
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
    )
    price = F.col("l_extendedprice") / F.col("l_quantity")
    shares = (F.lit(1000) * (1 + F.col("l_suppkey") % 7)).cast("double")
    return (
        items.groupBy("l_suppkey", F.date_trunc(session, "l_shipdate").cast("date").alias("date"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.sum("l_quantity").alias("volume"),
            # Cents are summed as integers, so the total does not depend on row order.
            (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / 100.0).alias("amount"),
        )
        .select(
            F.expr(normalize_code("l_suppkey")).alias("code"),
            "date",
            "open",
            "high",
            "low",
            "close",
            F.col("close").alias("close_raw"),
            "volume",
            "amount",
            (F.col("volume") * 100 / shares).alias("turnover"),
            (F.col("close") * shares).alias("market_cap"),
        )
        .repartition(instrument_partitions(items), "code")
    )


def membership(spark: SparkSession, folder: str) -> DataFrame:
    """(code, block): nation and region of the supplier, and every brand it shipped."""
    supplier = table(spark, folder, "supplier")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    code = F.expr(normalize_code("s_suppkey")).alias("code")
    places = (
        supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(code, F.explode(F.array("n_name", "r_name")).alias("block"))
    )
    brands = (
        table(spark, folder, "lineitem")
        .select("l_suppkey", "l_partkey")
        .join(table(spark, folder, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.expr(normalize_code("l_suppkey")).alias("code"), F.col("p_brand").alias("block"))
        .distinct()
    )
    return places.unionByName(brands)


def industry(spark: SparkSession, folder: str) -> DataFrame:
    """(code, industry): the nation of each supplier, one row per code."""
    supplier = table(spark, folder, "supplier")
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return supplier.join(F.broadcast(nation), "s_nationkey", "left").select(
        F.expr(normalize_code("s_suppkey")).alias("code"),
        F.coalesce("n_name", F.lit("UNKNOWN")).alias("industry"),
    )


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """One trade print per event."""
    return table(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("time"),
        F.col("ts").cast("date").alias("date"),
        F.expr(normalize_code("user_id")).alias("code"),
        F.col("value").alias("price"),
        (F.col("event_id") % 10 + 1).cast("double").alias("volume"),
        (F.col("value") * (F.col("event_id") % 10 + 1)).alias("amount"),
        F.when(F.col("event_type") == "purchase", 1)
        .when(F.col("event_type") == "error", -1)
        .otherwise(0)
        .alias("direction"),
        F.col("event_id").alias("seq"),
    )


def order_book(spark: SparkSession, folder: str) -> DataFrame:
    """Ten levels around each print, by fixed arithmetic on the event id."""
    eid = F.col("seq")

    def level(k):
        return F.struct(
            k.alias("level"),
            (F.col("price") - k * 0.01).alias("bid_price"),
            (((eid + k * 7) % 13) * 10 + F.when((eid + k) % 11 == 0, 300).otherwise(1)).cast("double").alias("bid_volume"),
            (F.col("price") + k * 0.01).alias("ask_price"),
            (((eid + k * 5) % 17) * 10 + F.when((eid + k) % 19 == 0, 400).otherwise(1)).cast("double").alias("ask_volume"),
        )

    return ticks(spark, folder).select(
        "code", "date", "time", "seq", F.transform(F.sequence(F.lit(1), F.lit(10)), level).alias("levels")
    )


def money_flow(spark: SparkSession, folder: str) -> DataFrame:
    """Per code and week: inflow (flag N), outflow (flag R), net, total amount, turnover, change."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_suppkey", F.date_trunc("week", "l_shipdate").cast("date").alias("date"))
        .agg(
            (F.coalesce(F.sum(F.when(F.col("l_returnflag") == "N", cents)), F.lit(0)) / 100.0).alias("inflow"),
            (F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", cents)), F.lit(0)) / 100.0).alias("outflow"),
            (F.sum(cents) / 100.0).alias("amount"),
            F.sum("l_quantity").alias("volume"),
        )
        .select(
            F.expr(normalize_code("l_suppkey")).alias("code"),
            "date",
            "inflow",
            "outflow",
            (F.col("inflow") - F.col("outflow")).alias("net_flow"),
            "amount",
            (F.col("volume") * 100 / (1000 * (1 + F.col("l_suppkey") % 7))).alias("turnover"),
        )
    )


def big_deals(spark: SparkSession, folder: str) -> DataFrame:
    """One large print per line item, dated by its week; flag A buys, flag R sells."""
    return table(spark, folder, "lineitem").select(
        F.expr(normalize_code("l_suppkey")).alias("code"),
        F.date_trunc("week", "l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        F.col("l_extendedprice").alias("amount"),
        F.when(F.col("l_returnflag") == "A", "buy").when(F.col("l_returnflag") == "R", "sell").otherwise("").alias("direction"),
    )


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog entries from documents; the whole text is the summary."""
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("source_id"),
        F.element_at(F.split("text", "\n"), 1).alias("title"),
        F.col("source").alias("family_id"),
        F.array("lang").alias("topics"),
        F.col("text").alias("summary"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("date_start"),
        F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("unknown").alias("reliability"),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
