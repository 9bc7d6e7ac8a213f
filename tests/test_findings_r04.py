"""Cases of the findings of round 4, each small enough to check by hand or by a direct loop."""

import datetime
import random

from tapeloom.operators import indicators

DAY = datetime.date(2024, 1, 1)


def day(n):
    return DAY + datetime.timedelta(n)


def test_recurrences_are_stepped_as_they_are_defined(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for code, n in [("one", 1), ("two", 2), ("sixteen", 17), ("more", 18), *[(f"{k:03}", 40) for k in range(60)]]:
        # A lone pulse in a fall to ever new lows: two rows later K and D are equal but for rounding, which the definition fixes.
        low = [100.0 - k - rng.random() for k in range(n)]
        close = [v + (rng.random() if k % 9 == 2 else 0.0) for k, v in enumerate(low)]
        k = d = e = white = None
        for t in range(n):
            top, base = max(v + 1 for v in low[max(0, t - 8) : t + 1]), min(low[max(0, t - 8) : t + 1])
            rsv = 100 * (close[t] - base) / (top - base)
            k, d = (rsv, rsv) if t == 0 else (rsv / 3.0 + k * 2 / 3.0, (rsv / 3.0 + k * 2 / 3.0) / 3.0 + d * 2 / 3.0)
            e, white = (close[t],) * 2 if t == 0 else (2 / 11.0 * close[t] + 9 / 11.0 * e, 2 / 11.0 * (2 / 11.0 * close[t] + 9 / 11.0 * e) + 9 / 11.0 * white)
            rows.append((code, day(t), low[t] + 0.5, low[t] + 1, low[t], close[t], 100.0))
            want[code, day(t)] = (k, d, white)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double").repartition(3, "code")
    got = {(r.code, r.date): (r.K, r.D, r.white_line) for r in indicators.add_indicators(df).collect()}
    assert got == want
    assert any(abs(k - d) < 1e-12 < k and k < d for k, d, _ in want.values())


def test_pairs_of_blocks_are_not_written_once_for_each_pair(spark, monkeypatch):
    import numpy as np

    from tapeloom.operators import patterns

    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    def nearest(f, f_curve, c, c_curve):
        apart = np.abs(f_curve[:, None] - c_curve[None]).sum(axis=2)
        return np.arange(len(f_curve)), apart.argmin(axis=1), -apart.min(axis=1)

    rng = random.Random(6)
    rows = [(f"{k:03}", k % 2, [float(k)], [rng.random() for _ in range(100)]) for k in range(300)]
    f = spark.createDataFrame(rows[:150], "id string, back int, x array<double>, curve array<double>").cache()
    c = spark.createDataFrame(rows[150:], "case_id string, back int, x array<double>, curve array<double>").cache()
    want = {}
    for i, back, _, a in rows[:150]:
        want[i] = min((sum(abs(p - q) for p, q in zip(a, b)), j) for j, other, _, b in rows[150:] if other == back)[1]
    monkeypatch.setattr(patterns, "ARRAY_PARTS", 2)
    sizes = []
    for cases in (150, 10):
        monkeypatch.setattr(patterns, "ARRAY_CASES", cases)
        before, best = written(), {}
        for r in patterns.case_pairs(f, c, nearest).collect():
            best[r.id] = max(best.get(r.id, (r.near, r.case_id)), (r.near, r.case_id))
        sizes.append(written() - before)
        assert {i: j for i, (_, j) in best.items()} == want
    assert sizes[1] < 3 * sizes[0]
