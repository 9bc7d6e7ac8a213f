"""What must not change with size: long identifiers, deep trees, long holds, large libraries."""

import datetime as dt

import pytest

from tapeloom.functions.scalars import normalize_code, strip_market_prefix
from tapeloom.operators import catalog, outcomes, patterns
from tapeloom.sources import warehouse


def test_long_identifiers_stay_apart(spark, tmp_path):
    rows = [(k, line, k % 5, s, 10.0, 100.0 + k, 0.0, 0.0, dt.date(1996, 1, 1)) for k, s in enumerate((1000000, 1000009, 7)) for line in (1, 2)]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate date"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [r.code for r in warehouse.bars(spark, str(tmp_path)).orderBy("code").collect()]
    assert got == ["000007", "1000000", "1000009"]
    text = spark.createDataFrame([("sh1000009",), ("0.600000",), ("abc",), ("1000009.0",)], "m string")
    assert [r[0] for r in text.selectExpr(strip_market_prefix("m")).collect()][:3] == ["1000009", "600000", "abc"]
    assert text.selectExpr(normalize_code("m")).collect()[3][0] == "1000009"


def test_deep_chains_and_cycles(spark):
    chain = spark.createDataFrame([(k, k - 1 if k else None) for k in range(60)], "id long, parent_id long")
    got = {r.id: (r.generation, r.root) for r in catalog.lineage(chain).collect()}
    assert got == {k: (k, 0) for k in range(60)}
    kinds = spark.createDataFrame([(k, [k - 1] if k else [], "map" if k == 0 else "note") for k in range(60)], "id long, parent_ids array<long>, object_type string")
    assert {r.id: r.has_ancestor for r in catalog.has_ancestor_type(kinds, "map").collect()} == {k: k > 0 for k in range(60)}
    with pytest.raises(ValueError, match="cycle"):
        catalog.lineage(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "id long, parent_id long"))


def test_daily_bars_reach_the_longest_hold(spark):
    start = dt.date(2024, 1, 1)
    days = [("A", k + 1, start + dt.timedelta(days=k + k // 5 * 2), 9.9, 10.5 + k / 1000, 10.0, 9.0) for k in range(120)]
    bars = spark.createDataFrame(days, "code string, rn int, date date, low double, close double, white_line double, yellow_line double")
    bars = bars.selectExpr("*", "close AS open", "close AS high", "100D AS volume", "1D AS ma5", "2D AS ma10", "3D AS ma20")
    trades = spark.createDataFrame([("A", start, 10.0, 1, 5.0)], "code string, entry_date date, entry_price double, entry_rn int, stop_price double")
    got = outcomes.exit_rules(trades, bars).first()
    assert got.exit_reason == "max_hold" and (got.exit_date - start).days >= 60


def test_case_libraries_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(patterns, "BLOCK_CASES", 3)
    monkeypatch.setattr(patterns, "PARTS", 2)
    rows = [("c", k, [float((k * j) % 7) / 7 for j in range(101)]) for k in range(40)]
    signals = spark.createDataFrame(rows, "code string, date long, curve array<double>")
    cases = signals.selectExpr("concat('case', date) AS case_id", "curve")
    got = {r.date: (r.curve_similarity, r.best_case) for r in patterns.elastic_match(signals, cases).collect()}
    same = {tuple(c): f"case{max((k for _, k, x in rows if x == c), key=lambda k: f'case{k}')}" for _, _, c in rows}
    assert got == {k: (1.0, same[tuple(c)]) for _, k, c in rows}
