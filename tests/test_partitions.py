"""Dated folders and files, and reachability in deep and cyclic catalogs."""

import datetime

from tapeloom.operators import navigation as nav
from tapeloom.session import shared_folder
from tapeloom.sources import partitions as pt
from tapeloom.sources import ticks

DAY = datetime.date(2024, 3, 1)


def day(n):
    return DAY + datetime.timedelta(n)


def rows(spark, days, mark):
    return spark.createDataFrame([(f"{c:06d}", float(k), mark, day(k)) for k in days for c in range(5)], "code string, x double, mark string, date date")


def test_old_partitions_go_and_others_stay(spark):
    path = f"{shared_folder(spark, 'days')}/t"
    pt.save_days(rows(spark, range(6), "first"), path)
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{path}/date=unknown")
    assert pt.days(spark, path) == [day(k) for k in range(6)]
    files = {f for f, d in pt.day_folders(spark, path) if d >= day(3)}
    assert pt.drop_before(spark, path, day(3)) == [day(k) for k in range(3)]
    assert pt.days(spark, path) == [day(k) for k in range(3, 6)] and {f for f, _ in pt.day_folders(spark, path)} == files
    assert pt.drop_before(spark, path, day(3)) == []
    assert spark.read.parquet(f"{path}/date=unknown").count() == 1


def test_days_are_replaced_whole_and_read_by_range(spark):
    path = f"{shared_folder(spark, 'days')}/t"
    pt.save_days(rows(spark, range(4), "first"), path)
    pt.save_days(rows(spark, [2], "second").limit(2), path)
    got = {(r.date, r.mark): r.n for r in pt.read_days(spark, path, str(day(1)), str(day(2))).groupBy("date", "mark").agg({"x": "count"}).toDF("date", "mark", "n").collect()}
    assert got == {(day(1), "first"): 5, (day(2), "second"): 2}
    plan = pt.read_days(spark, path, str(day(1)), str(day(2)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_nested_and_compact_days(spark):
    path = f"{shared_folder(spark, 'nested')}/t"
    for stock, d in (("a", "20240301"), ("a", "20240305"), ("b", "20240301")):
        spark.createDataFrame([(1.0,)], "x double").write.parquet(f"{path}/stock={stock}/day={d}")
    assert pt.drop_before(spark, path, day(2), "day") == [DAY]
    assert pt.days(spark, path, "day") == [day(4)]
    assert pt.days(spark, f"{path}/nothing") == []


def test_ticks_can_be_dropped_by_day(spark):
    path = f"{shared_folder(spark, 'ticks')}/t"
    df = spark.createDataFrame([("A", datetime.datetime(2024, 3, 1 + k, 10), k) for k in range(5)], "code string, time timestamp, seq long")
    ticks.write_ticks(df, path)
    pt.drop_before(spark, path, day(3))
    assert {r.seq for r in ticks.read_ticks(spark, path, "2024-01-01", "2024-12-31").collect()} == {3, 4}


def test_dates_come_from_file_names(spark, tmp_path):
    for name, x in (("2024-03-01", 1), ("20240302", 2), ("2024-03-03", 3), ("notes", 4)):
        (tmp_path / f"{name}.csv").write_text(f"concept,net\nc,{x}\n")
    schema = "concept string, net double"
    assert {(r.date, r.net) for r in pt.read_named_days(spark, str(tmp_path), schema).collect()} == {(day(0), 1.0), (day(1), 2.0), (day(2), 3.0)}
    assert {r.date for r in pt.read_named_days(spark, str(tmp_path), schema, last=2).collect()} == {day(1), day(2)}
    assert pt.read_named_days(spark, f"{tmp_path}/none", schema).count() == 0


def test_a_deep_chain_and_a_cycle_are_reached_by_layer(spark):
    chain = [(k, [k - 1] if k else [], "map" if k == 0 else "page") for k in range(61)]
    cycle = [(100, [101], "page"), (101, [100], "page"), (102, [100, 60], "page"), (103, [102, 999], "page")]
    nodes = spark.createDataFrame(chain + cycle, "id long, parent_ids array<long>, object_type string")
    got = {r.id: r.layer for r in nav.reach_layers(nodes, "map").collect()}
    assert got == {k: k for k in range(61)} | {102: 61, 103: 62}
    assert nav.reach_layers(nodes, "nothing").count() == 0


def test_reasons_and_priorities(spark):
    schema = "id long, object_type string, parent_ids array<long>, family_id long, date_start string, warnings array<string>, packet_path string, packet_readable boolean, summary boolean, statements boolean, evidence boolean, raw_path string, raw_exists boolean"
    full = ("p", True, True, True, True, "r", True)
    nodes = spark.createDataFrame([
        (1, "map", [], None, None, None, *full),
        (2, "family", [], None, None, None, *full),
        (3, "source_packet", [1], None, None, None, *full),
        (4, "source_packet", [1, 77], None, None, None, *full),
        (5, "source_packet", [], 2, None, None, "p", True, False, True, True, "r", True),
        (6, "source_packet", [77], None, None, [], *full),
        (7, "source_packet", [], None, "2024-01-01", ["manual_review_no_supported_items"], "p", True, True, False, False, "r", True),
        (8, "source_packet", [1], None, None, ["manual_review_no_supported_items"], "p", True, True, False, False, None, None),
        (9, "source_packet", None, None, None, None, None, None, None, None, None, None, None),
    ], schema)
    got = {r.id: (r.navigable, r.reasons, r.priority) for r in nav.navigation_coverage(nodes).collect()}
    assert got == {
        3: (True, "", None),
        4: (True, "unresolved_parent", "P2"),
        5: (True, "missing_summary", "P1"),
        6: (False, "not_navigable,unresolved_parent", "P0"),
        7: (True, "missing_statements,missing_evidence,manual_review_no_supported_items", None),
        8: (True, "missing_statements,missing_evidence,missing_raw,manual_review_no_supported_items", "P0"),
        9: (False, "packet_path_missing,not_navigable,missing_summary,missing_statements,missing_evidence,missing_raw", "P0"),
    }
    queue = nav.gap_queue(nav.navigation_coverage(nodes)).orderBy("place").collect()
    assert [r.id for r in queue] == [6, 8, 9, 5, 4]
