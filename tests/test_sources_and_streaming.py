"""File round trips and streaming runs on small inputs."""

import datetime as dt
import os

import pandas as pd
import pytest

from tapeloom.operators.ticks import tick_surge
from tapeloom.sources import bars as src
from tapeloom.sources import ticks as tsrc
from tapeloom.streaming import ticks as st

HEADER = "date,open,high,low,close,volume,close_raw,amount,turnover,market_cap,change,change_pct,amplitude\n"


def test_csv_files_carry_their_code(spark, tmp_path):
    (tmp_path / "000001.csv").write_text(HEADER + "2024-01-03,2,3,1,2,10,2,20,1,100,0,0,0\n2024-01-02,1,x,1,1,5,1,5,1,100,0,0,0\n2024-01-01,1,1,1,1,0,1,5,1,100,0,0,0\n")
    raw = src.read_bars_csv(spark, str(tmp_path))
    rows = src.normalize_bars(raw).collect()
    assert [(r.code, r.date, r.close) for r in rows] == [("000001", dt.date(2024, 1, 3), 2.0)]


def test_yearly_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "bars")
    frame = lambda rows: spark.createDataFrame(rows, "code string, date date, close double")
    src.write_bars(frame([("A", dt.date(2023, 1, 2), 1.0), ("A", dt.date(2024, 1, 2), 2.0)]), path)
    src.write_bars(frame([("A", dt.date(2024, 1, 2), 3.0)]), path)
    assert sorted(r.close for r in spark.read.parquet(path).collect()) == [1.0, 3.0]


def test_signals_keep_their_columns_without_rows(spark, tmp_path):
    src.write_signals(spark.createDataFrame([], src.SIGNAL_COLUMNS), str(tmp_path / "s"))
    files = [f for f in os.listdir(tmp_path / "s") if f.endswith(".csv")]
    assert files == [] or open(tmp_path / "s" / files[0]).readline().startswith("code,signal_date")


def tick_rows(n=200):
    base = dt.datetime(2024, 1, 2, 9, 30)
    return [(base + dt.timedelta(seconds=7 * i + (0 if i < 150 else -7 * (i - 150))), f"{i % 2:06d}", i, 10.0 + i % 3, 1.0 + i % 4, (i % 3) - 1) for i in range(n)]


TICKS = "time timestamp, code string, seq long, price double, volume double, direction int"


def test_ticks_round_trip_by_day(spark, tmp_path):
    path = str(tmp_path / "ticks")
    tsrc.write_ticks(spark.createDataFrame(tick_rows(), TICKS), path)
    got = tsrc.read_ticks(spark, path, "2024-01-02", "2024-01-02", ["000001"])
    assert got.count() == 100
    assert tsrc.read_ticks(spark, path, "2024-01-03", "2024-01-09").count() == 0


def test_wide_snapshots_become_levels(spark):
    cols = {f"{c}_{k:02d}": float(k) for k in range(1, 11) for c in ("bid_price", "bid_volume", "ask_price", "ask_volume")}
    row = tsrc.wide_to_levels(spark.createDataFrame(pd.DataFrame([{"code": "A", **cols}]))).first()
    assert len(row.levels) == 10 and row.levels[4].ask_volume == 5.0


def test_stream_drops_repeats_and_counts_final_windows(spark, tmp_path):
    rows = tick_rows()
    spark.createDataFrame(rows + rows[:20], TICKS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = st.ticks_stream(spark, str(tmp_path / "in"), TICKS)
    st.run_to_table(st.intensity_stream(stream), str(tmp_path / "out"), str(tmp_path / "chk"))
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    pdf = pd.DataFrame(rows, columns=["time", "code", "seq", "price", "volume", "direction"])
    pdf["slot"] = pdf["time"].dt.floor("min")
    want = pdf.groupby(["code", "slot"]).size()
    final = pdf["time"].max() - pd.Timedelta("2min")
    want = want[[s + pd.Timedelta("1min") <= final for _, s in want.index]]
    assert got.set_index(["code", "slot"])["ticks"].sort_index().to_dict() == want.to_dict()


def test_surges_of_a_stream_are_written_once_per_batch(spark, tmp_path):
    spark.createDataFrame(tick_rows(), TICKS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = st.ticks_stream(spark, str(tmp_path / "in"), TICKS).withColumn("date", pytest.importorskip("pyspark.sql.functions").to_date("time"))
    find = lambda batch: tick_surge(batch, ("date",), "minute", 2.0, 20)
    st.for_each_surge(stream, str(tmp_path / "out"), str(tmp_path / "chk"), find)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = find(spark.createDataFrame(tick_rows(), TICKS).selectExpr("*", "to_date(time) AS date"))
    assert sorted(r.ticks for r in got.collect()) == sorted(r.ticks for r in want.collect()) and want.count() > 0


def test_whale_state_carries_over_batches(spark, tmp_path):
    schema = "code string, date date, net_buy_vol double"
    for k, v in enumerate([5.0, -1.0, 4.0, 3.0]):
        spark.createDataFrame([("A", dt.date(2024, 1, 2 + k), v)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    st.run_to_table(st.whale_stream(stream), str(tmp_path / "out"), str(tmp_path / "chk"))
    got = {r.date.day: (r.net_buy_days, r.net_volume) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {4: (2, 8.0), 5: (3, 11.0)}
