"""Faults found in round 3, each on a small input."""

import datetime as dt
import random

from tapeloom.functions import quantiles, windows
from tapeloom.operators import features, flows, joins, pools, scoring, stats, ticks
from tapeloom.operators.brick import FEATURES
from tapeloom.sources import warehouse
from tapeloom.suite import catalog as catalog_suite


def test_resonance_of_islands_is_that_of_pairs(spark):
    random.seed(3)
    day = dt.date(2024, 1, 1)
    signals = sorted({(f"c{random.randrange(9)}", day + dt.timedelta(days=random.randrange(60))) for _ in range(70)})
    bridge = [(f"c{c}", f"b{b}") for c in range(9) for b in range(4) if (c * 7 + b * 3) % 5 < 3]
    got = joins.concept_resonance(spark.createDataFrame(signals + signals[:5], "code string, date date"), spark.createDataFrame(bridge, "code string, block string"), 3)
    # The days reached are never copied per member: no sequence of them stands below a join with the blocks.
    near = {b: {(c, d) for c, d in signals if (c, b) in bridge} for b in {b for _, b in bridge}}
    size = {b: sum(x == b for _, x in bridge) for b in near}
    want = {}
    for (b, rows) in near.items():
        for c, d in rows:
            share = len({x for x, e in rows if abs((e - d).days) <= 3}) / size[b]
            want[c, d] = max(want.get((c, d), 0), share)
    assert {(r.code, r.date): r.resonance for r in got.collect()} == want


def test_resonance_sends_members_not_days(spark):
    """A member that signals every day for long makes one island: two rows meet the blocks, not one for each day reached."""
    days = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=k)) for k in range(300)]
    signals = spark.createDataFrame(days, "code string, date date")
    bridge = spark.createDataFrame([("a", "x"), ("b", "x")], "code string, block string")
    got = joins.concept_resonance(signals, bridge, 14)
    assert [r.resonance for r in got.collect()] == [0.5] * 300
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan


def test_whale_signals_from_a_price_of_zero(spark):
    day = dt.date(2024, 1, 1)
    rows = [("a", day, 60, 5.0, 0.0, 100.0, 10.0), ("a", day + dt.timedelta(days=1), 60, 5.0, 3.0, 100.0, 10.0), ("b", day, 60, 5.0, 2.0, 100.0, 10.0), ("b", day + dt.timedelta(days=1), 60, 5.0, 2.0, 100.0, 10.0)]
    f = spark.createDataFrame(rows, "code string, date date, total_ticks long, net_buy_vol double, price_vwap double, big_order_buy_ratio double, institutional_net_flow double")
    assert [(r.code, r.date, r.signal_type) for r in ticks.whale_signals(f).collect()] == [("b", day + dt.timedelta(days=1), "whale_accumulation")]


def test_ngram_terms_leaves_out_documents_without_terms(spark, tmp_path):
    rows = [(1, "two words"), (2, "? !"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.doc_id, r.n_terms) for r in catalog_suite.QUERIES["ngram_terms"](spark, str(tmp_path)).collect()] == [(1, 2)]


def test_coverage_counts_values_to_digits(spark):
    df = spark.createDataFrame([(0.1 + 0.2,), (0.3,), (0.5,), (None,)], "f double")
    assert [r.distinct_values for r in stats.coverage_report(df, ["f"], 12).collect()] == [2]
    assert [r.distinct_values for r in stats.coverage_report(df, ["f"]).collect()] == [3]


def test_concepts_of_equal_flow_tie(spark):
    """The members of both concepts hold the same amounts in another order, so a sum of doubles tells them apart."""
    amounts = [1e9 + 0.1, 0.3, 7e8 + 0.7, 0.2, -1.7e9]
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(3)]
    flow = [(f"{side}{k}", d, x, 0.0, x, 2e9) for d in days for side, xs in (("a", amounts), ("b", amounts[::-1])) for k, x in enumerate(xs)]
    f = spark.createDataFrame(flow, "code string, date date, inflow double, outflow double, net_flow double, amount double").coalesce(1)
    bridge = spark.createDataFrame([(f"{s}{k}", s) for s in "ab" for k in range(5)], "code string, block string")
    got = flows.concept_strength(flows.concept_flow(f, bridge), 3).collect()
    assert len({r.total_net for r in got}) == 1 and len({r.strength_score for r in got}) == 1


def test_concept_rank_by_buckets_is_that_of_the_whole_block(spark):
    random.seed(5)
    day = dt.date(2024, 1, 1)
    rows = [(f"c{c}", day + dt.timedelta(days=k), random.choice([None, -30.0, 0.0, 0.2, 5.0, 70.0, round(random.random() * 100, 1)])) for c in range(12) for k in range(3)]
    bridge = [(f"c{c}", f"b{b}") for c in range(11) for b in range(5) if (c * 3 + b * b) % 4 < 2]
    df = spark.createDataFrame(rows, "code string, date date, quality_score double")
    out = features.concept_rank(df, spark.createDataFrame(bridge, "code string, block string"))
    # No window over the product of rows and blocks: each row travels once, with the list of its blocks.
    assert "rank(quality_score)" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for c, d, q in rows:
        ranks, zs = [], []
        for b in sorted({b for x, b in bridge if x == c}):
            peers = [y for x, e, y in rows if e == d and (x, b) in bridge]
            if len(peers) < 3:
                continue
            known = [y for y in peers if y is not None]
            ranks.append(0 if q is None else sum(y is None or y < q for y in peers) / len(peers))
            if q is not None:
                mean = sum(known) / len(known)
                sd = (sum((y - mean) ** 2 for y in known) / len(known)) ** 0.5
                zs.append((q - mean) / (sd if sd > 1e-6 else 1))
        z = max(-3, min(3, sum(zs) / len(zs))) / 3 if zs else 1  # The least of 3 and nothing is 3, in the SQL too.
        want[c, d] = (round(sum(ranks) / len(ranks), 9) if ranks else 0.5, round(z, 9))
    assert {(r.code, r.date): (round(r.concept_rank, 9), round(r.concept_dev, 9) + 0.0) for r in out.collect()} == want


def test_only_the_named_ranks_are_formed(spark):
    df = spark.createDataFrame([(f"c{k}", dt.date(2024, 1, 1), float(k)) for k in range(4)], "code string, date date, lower_shadow double")
    got = features.cross_section_ranks(df, names=["cs_lower_shadow"])
    assert got.columns == ["code", "date", "lower_shadow", "cs_lower_shadow"] and {r.code: r.cs_lower_shadow for r in got.collect()} == {"c0": 0.0, "c1": 25.0, "c2": 50.0, "c3": 75.0}


def test_rolling_z_score_moves_no_rows(spark):
    """The rows meet one row of moments a session; they are not dealt out by feature and put together again."""
    random.seed(11)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(14)]
    rows = [(f"c{c}", d, d, *[None if random.random() < 0.1 else random.choice([0.5, random.random() * 9]) for _ in FEATURES]) for d in days for c in range(4)]
    df = spark.createDataFrame(rows, "code string, signal_date date, entry_date date, " + ", ".join(f"{f} double" for f in FEATURES))
    got = scoring.rolling_z_score(df, sessions=12, least=10)
    assert "first(row" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for row in rows:
        score = 0.0
        for k, f in enumerate(FEATURES, 3):
            at = days.index(row[2])
            past = [r[k] for r in rows if 1 <= at - days.index(r[2]) <= 12 and r[k] is not None]
            if at >= 10 and len(past) >= 10 and row[k] is not None:
                mean = sum(past) / len(past)
                sd = (sum((x - mean) ** 2 for x in past) / (len(past) - 1)) ** 0.5
                score += (row[k] - mean) / sd * scoring.Z_WEIGHTS[f] / sum(scoring.Z_WEIGHTS.values())
        want[row[0], row[2]] = round(score, 8)
    assert {(r.code, r.entry_date): round(r.score, 8) for r in got.collect()} == want and any(want.values())


def test_partitions_of_bars_grow_with_the_items(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    monkeypatch.setattr(warehouse, "ITEMS_PER_PARTITION", items // 37 + 1)
    b = warehouse.bars(spark, folder)
    assert b.rdd.getNumPartitions() == 37
    # The windows of an instrument use these partitions: no further exchange.
    assert b.selectExpr("code", "lag(close) OVER (PARTITION BY code ORDER BY date) AS pc").rdd.getNumPartitions() == 37


def test_small_values_spread_over_buckets(spark):
    df = spark.createDataFrame([(float(s) * k / 1000,) for s in (-1, 1) for k in range(61)] + [(float("nan"),), (float("inf"),)], "_v double")
    rows = df.selectExpr("_v", f"{quantiles._BUCKET} AS b").distinct().orderBy("_v").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows) and len({r.b for r in rows}) > 80


def test_dimension_score_adds_in_one_order(spark):
    rows = [(f"c{c}", dt.date(2024, 1, 1), dt.date(2024, 1, 2), *[float((c * 7 + k * 3) % 5) for k in range(len(FEATURES))]) for c in range(6)]
    got = scoring.dimension_score(spark.createDataFrame(rows, "code string, signal_date date, entry_date date, " + ", ".join(f"{f} double" for f in FEATURES)))
    assert "rank * " not in got._jdf.queryExecution().optimizedPlan().toString() and "sum(CASE" not in got._jdf.queryExecution().optimizedPlan().toString()
    at = {r[0]: {f: r[3 + k] for k, f in enumerate(FEATURES)} for r in rows}
    for r in got.collect():
        def share(f):
            vs = [v[f] for v in at.values()]
            return (sum(v < at[r.code][f] for v in vs) + sum(v <= at[r.code][f] for v in vs) + 1) / 2 / len(vs)
        for d, ws in scoring.DIMENSION_FEATURES.items():
            terms = [share(f) * wt for f, wt in ws.items()]
            total = terms[0]
            for t in terms[1:]:
                total += t
            assert r[f"dim_{d}"] == total / sum(ws.values())


def test_sector_rows_do_not_travel_once_per_metric(spark):
    day = dt.date(2024, 1, 1)
    raws = [raw for raw, _ in pools.SECTOR_RANKS.values()]
    rows = [(f"c{k}", day, *[float((k * (j + 2)) % 5) if (k + j) % 6 else None for j in range(5)]) for k in range(8)]
    metrics = spark.createDataFrame(rows, "code string, date date, " + ", ".join(f"{r} double" for r in raws))
    blocks = spark.createDataFrame([(f"c{k}", b) for k in range(7) for b in ("x", "y") if b == "x" or k % 2], "code string, block string")
    got = pools.sector_relative(metrics, blocks)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    member = {"x": list(range(7)), "y": [1, 3, 5], "UNKNOWN": [7]}
    want = {}
    for j, inverse in enumerate(inv for _, inv in pools.SECTOR_RANKS.values()):
        for b, ks in member.items():
            have = [rows[k][2 + j] for k in ks if rows[k][2 + j] is not None]
            for k in ks:
                v = rows[k][2 + j]
                if v is None or len(have) < 3:
                    rel = 0.5
                else:
                    rank = (sum(x < v for x in have) + (sum(x == v for x in have) + 1) / 2) / len(have)
                    rel = 1 - rank if inverse else rank
                want.setdefault((f"c{k}", j), []).append(rel)
    for r in got.collect():
        for j, n in enumerate(pools.SECTOR_RANKS):
            rels = want[r.code, j]
            assert abs(r[n] - sum(rels) / len(rels)) < 1e-12


def test_factor_library_evaluates_each_frame_once(spark):
    columns = "open high low close volume turnover market_cap amount".split()
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(weeks=k), *[float((k * (j + 3)) % 11 + 1) for j in range(8)]) for k in range(30)]
    bars = spark.createDataFrame(rows, "code string, date date, " + ", ".join(f"{c} double" for c in columns))
    plan = pools.factor_library(bars).select(*pools.LIBRARY)._jdf.queryExecution().analyzed()
    seen, nodes = [], [plan]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Window":
            of = node.windowExpressions()
            seen += [of.apply(k).child().canonicalized().toString() for k in range(of.size()) if "lag(" not in of.apply(k).child().toString()]
    assert len(seen) == len(set(seen))


def test_window_median_and_rank_of_sorted_frames(spark):
    values = [3.0, None, 1.0, 1.0, 5.0, 2.0, None, 2.0, 2.0, 0.0]
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1) + dt.timedelta(days=k), v) for k, v in enumerate(values)], "code string, date date, v double")
    got = df.selectExpr("date", f"{windows.rolling_median('v', 4, 2)} AS m", f"{windows.rolling_pct_rank('v', 4, 2)} AS r").orderBy("date").collect()
    for k, row in enumerate(got):
        have = sorted(v for v in values[max(0, k - 3) : k + 1] if v is not None)
        n, v = len(have), values[k]
        assert row.m == (None if n < 2 else (have[(n - 1) // 2] + have[n // 2]) / 2)
        assert row.r == (None if v is None or n < 2 else (sum(x < v for x in have) + (sum(x == v for x in have) + 1) / 2) / n)


def test_bars_leave_no_method_too_long_to_compile(spark):
    warehouse.bars(spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
