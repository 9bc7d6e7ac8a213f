"""Recurrences, quantiles, positions and ranks against direct computation."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tapeloom.functions.positions import sliding, with_positions
from tapeloom.functions.quantiles import exact_quantiles, group_avg_rank, ks_distance
from tapeloom.functions.ranks import pct_better, pct_rank_avg, top_n_group_cap
from tapeloom.functions.recurrence import add_recurrences, ema, sma_weighted


def series(n, codes=("A", "B"), seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in codes:
        x = rng.normal(0, 50, n).cumsum()
        rows += [(c, dt.date(2000, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)]
    return pd.DataFrame(rows, columns=["code", "date", "x"])


@pytest.mark.parametrize("block", [16, 100, 512])
def test_recurrence_matches_direct_loop_over_many_blocks(spark, block):
    pdf = series(1500)
    df = spark.createDataFrame(pdf)
    got = add_recurrences(df, [ema("e", "x", 26), sma_weighted("s", "x", 3), ema("long", "x", 200)], block=block).toPandas()
    for code, g in got.sort_values(["code", "date"]).groupby("code"):
        for col, a in (("e", 25 / 27), ("s", 2 / 3), ("long", 199 / 201)):
            y, want = None, []
            for v in g["x"]:
                y = v if y is None else a * y + (1 - a) * v
                want.append(y)
            assert np.allclose(g[col], want, rtol=0, atol=1e-9 * g["x"].abs().max())


def test_recurrence_of_a_prefix_is_unchanged_by_later_rows(spark):
    pdf = series(300, ("A",))
    full = add_recurrences(spark.createDataFrame(pdf), [ema("e", "x", 12)]).toPandas().sort_values("date")
    part = add_recurrences(spark.createDataFrame(pdf.iloc[:200]), [ema("e", "x", 12)]).toPandas().sort_values("date")
    assert np.allclose(full["e"].to_numpy()[:200], part["e"], rtol=0, atol=1e-12)


def test_quantiles_with_a_hot_group(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": ["hot"] * 5000 + ["cold"] * 37, "x": np.round(rng.normal(0, 1000, 5037), 1)})
    got = exact_quantiles(spark.createDataFrame(pdf), ["k"], "x", {"a": 0.03, "m": 0.5, "z": 0.97}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert np.allclose(got.loc[k, ["a", "m", "z"]].astype(float), np.quantile(g["x"], [0.03, 0.5, 0.97]))


def test_group_rank_matches_pandas(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 800), "id": range(800), "x": rng.integers(-20, 20, 800).astype(float)})
    got = group_avg_rank(spark.createDataFrame(pdf), ["k"], "x", "r").toPandas().set_index("id").sort_index()
    assert np.allclose(got["r"], pdf.groupby("k")["x"].rank())


def test_ks_distance(spark):
    pdf = pd.DataFrame({"k": "a", "x": [1.0, 2, 3, 4, 2, 3, 4, 5, 6], "left": [True] * 4 + [False] * 5})
    row = ks_distance(spark.createDataFrame(pdf), ["k"], "x", "left").collect()[0]
    assert row.ks == pytest.approx(0.4) and (row.n_left, row.n_right) == (4, 5)


def test_sliding_frames_are_exact_across_chunks(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"code": "A", "blk": np.sort(rng.integers(0, 9, 500)), "seq": range(500), "v": rng.normal(size=500)})
    placed = with_positions(spark.createDataFrame(pdf), ["code"], "blk", "seq", {"run": "v"})
    got = sliding(placed, ["code"], 50, {"s": "sum(v)"}, chunk=64).toPandas().sort_values("seq")
    assert list(got["pos"]) == list(range(500)) and set(got["size"]) == {500}
    assert np.allclose(got["run"], pdf["v"].cumsum())
    assert np.allclose(got["s"], pdf["v"].rolling(50, min_periods=1).sum())


def test_rank_conventions(spark):
    pdf = pd.DataFrame({"d": [1] * 5 + [2] * 2, "code": list("abcdefg"), "x": [1.0, 2, 2, None, 4, 7, 8]})
    got = spark.createDataFrame(pdf).selectExpr("code", f"{pct_rank_avg('x', 'd', 0.5)} AS avg", f"{pct_better('code', 'd')} AS strict").toPandas().set_index("code")
    assert list(got["avg"]) == [0.25, 0.625, 0.625, 0.5, 1.0, 0.5, 1.0]
    assert list(got.loc[list("abcde"), "strict"]) == [0, 20, 40, 60, 80] and list(got.loc[list("fg"), "strict"]) == [50, 50]


def test_group_cap_equals_the_greedy_pick(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"d": rng.integers(0, 4, 200), "code": [f"{i:03d}" for i in range(200)], "g": rng.integers(0, 5, 200), "s": rng.permutation(200)})
    got = top_n_group_cap(spark.createDataFrame(pdf), 6, 2, "d", "g", "s DESC, code").toPandas()
    for d, part in pdf.groupby("d"):
        taken, count = [], {}
        for row in part.sort_values("s", ascending=False).itertuples():
            if count.get(row.g, 0) < 2 and len(taken) < 6:
                taken.append(row.code)
                count[row.g] = count.get(row.g, 0) + 1
        assert list(got[got["d"] == d].sort_values("rank")["code"]) == taken
