"""Structured Streaming over tick files: source, intensity, surges and stateful signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

WATERMARK = "2 minutes"


def ticks_stream(spark: SparkSession, path: str, schema: str, pattern: str | None = None, dedupe: bool = True) -> DataFrame:
    """Tick files as a stream with a watermark; a print repeated within it is dropped by (code, seq)."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    stream = reader.parquet(path)
    if "code" in stream.columns and dedupe:
        return stream.withWatermark("time", WATERMARK).dropDuplicatesWithinWatermark(["code", "seq"])
    return stream


def intensity_stream(stream: DataFrame, width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Prints, volume and signed volume per window and code; a window is emitted once it is final."""
    slot = F.window("time", width, slide) if slide else F.window("time", width)
    return stream.groupBy(slot.alias("w"), "code").agg(
        F.count(F.lit(1)).alias("ticks"), F.sum("volume").alias("volume"), F.sum(F.col("volume") * F.col("direction")).alias("delta")
    ).select("code", F.col("w.start").alias("slot"), "ticks", "volume", "delta")


def run_to_table(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available into a parquet table, restartable from its checkpoint."""
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def for_each_surge(stream: DataFrame, target: str, checkpoint: str, find: Callable[[DataFrame], DataFrame]) -> None:
    """Apply a batch operator to each finished micro-batch of window counts and append its rows.

    The batch id is a column and the write of a batch replaces its own folder, so a batch repeated
    after a failure does not count twice.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        find(batch).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def whale_stream(daily: DataFrame, periods: int = 5, least: int = 2) -> DataFrame:
    """Runs of net buying per code over its last ``periods`` feature rows, held as keyed state.

    The state of a code is its last ``periods`` net volumes, so it stays small whatever the volume. A batch holds a code's
    feature rows whole, one a day, however they are cut into Arrow chunks, and is read in order of date.
    """

    def update(key, batches, state):
        import pandas as pd

        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("date")
        net = pd.Series([*past, *rows["net_buy_vol"].astype(float)])
        frame = lambda s: s.rolling(periods, min_periods=1).sum().iloc[len(past) :].to_numpy()
        out = pd.DataFrame({"code": key[0], "date": rows["date"].to_numpy(), "net_buy_days": frame((net > 0).astype(float)).astype(int), "net_volume": frame(net)})
        state.update((net.iloc[-periods:].tolist(),))
        yield out[(out["net_buy_days"] >= least) & (rows["net_buy_vol"].to_numpy() > 0)]

    return daily.groupBy("code").applyInPandasWithState(
        update, "code string, date date, net_buy_days int, net_volume double", "past array<double>", "append", GroupStateTimeout.NoTimeout
    )
