"""Cases of the calibration operators that the registered queries do not single out."""

import datetime

import pytest

from tapeloom.operators import calibration as cal

DAY = datetime.date(2024, 1, 1)


def day(n):
    return DAY + datetime.timedelta(n)


def trusted(spark, n=40, skip=(), scale=1.5, base=0.2, code="A"):
    rows = [(code, day(k), 10 + k * 0.1, (10 + k * 0.1) * scale + base) for k in range(n) if k not in skip]
    return spark.createDataFrame(rows, "code string, date date, close_raw double, close double")


def targets(spark, *rows):
    return spark.createDataFrame([("A", day(k), x, y) for k, x, y in rows], "code string, date date, close_raw double, close_adjusted double")


def test_brackets_need_anchors_on_both_sides_and_not_on_the_day(spark):
    got = {r.date: r for r in cal.bracketed_transform(trusted(spark), targets(spark, (4, 10.4, None), (5, 10.5, None), (20, 12.0, 18.2), (21, 12.1, 18.5), (34, 13.4, None), (35, 13.5, None), (50, 9.0, None))).collect()}
    assert [got[day(k)].status for k in (4, 5, 20, 21, 34, 35, 50)] == [
        "insufficient_side_anchors", "accepted", "accepted", "target_mismatch", "accepted", "insufficient_side_anchors", "insufficient_side_anchors"
    ]
    r = got[day(20)]
    assert (r.before_points, r.after_points, r.anchor_points) == (20, 19, 39)
    assert r.slope == pytest.approx(1.5) and r.intercept == pytest.approx(0.2)


def test_brackets_are_limited_to_the_nearest(spark):
    far = trusted(spark, 100).selectExpr("code", "date", "close_raw", f"CASE WHEN date < DATE'{day(20)}' THEN close + 1 ELSE close END AS close")
    (r,) = cal.bracketed_transform(far, targets(spark, (60, 16.0, None))).collect()
    assert (r.before_points, r.after_points, r.status) == (30, 30, "accepted")
    (r,) = cal.bracketed_transform(far, targets(spark, (60, 16.0, None)), (5, 45)).collect()
    assert r.status == "rejected_fit"


def test_a_flat_price_proves_nothing(spark):
    flat = trusted(spark).selectExpr("code", "date", "10D AS close_raw", "15D AS close")
    (r,) = cal.bracketed_transform(flat, targets(spark, (20, 10.0, 15.0))).collect()
    assert (r.fit_status, r.status) == ("insufficient_affine_variation", "rejected_fit")


def test_no_anchor_no_target(spark):
    assert cal.bracketed_transform(trusted(spark), targets(spark)).count() == 0
    (r,) = cal.bracketed_transform(trusted(spark, 0), targets(spark, (3, 1.0, None))).collect()
    assert (r.before_points, r.status) == (0, "insufficient_side_anchors")


def test_anchors_of_another_factor_do_not_count(spark):
    rows = [("A", day(k), (10 + k * 0.1) * (2.0 if k % 2 else 3.0), 10 + k * 0.1, (10 + k * 0.1) * (1.2 if k % 2 else 1.7)) for k in range(60)]
    anchors = spark.createDataFrame(rows, "code string, date date, close_legacy double, close_raw double, close_adjusted double")
    asked = spark.createDataFrame([("A", day(31), 24.0, 12.0, 14.4, None), ("A", day(31), 24.003, 12.0, 14.4, None), ("A", day(30), 36.0, 12.0, 20.4, 12.0), ("A", day(30), 36.0, 12.0, None, None)],
        "code string, date date, close_legacy double, close_raw double, close_adjusted double, validation_raw double")
    got = sorted(cal.factor_matched_transform(anchors, asked).collect(), key=lambda r: (r.date, r.close_legacy, r.close_adjusted is None))
    assert [(r.anchor_points, r.status) for r in got] == [(29, "accepted"), (29, "no_adjusted_close"), (29, "accepted"), (0, "no_anchor")]
    assert got[0].slope == pytest.approx(1.7) and got[2].slope == pytest.approx(1.2)
    assert got[0].target_tolerance == pytest.approx(0.0051) and got[2].target_tolerance == 0.011


def shares(spark, jump_at=None, events=(), step_at=10, n=30):
    dates = spark.createDataFrame([("A", day(k), 10.0, 10.0 if jump_at is None or k < jump_at else 5.0) for k in range(n)], "code string, date date, close double, close_raw double")
    held = spark.createDataFrame([("A", day(-5), 100.0), ("A", day(step_at), 200.0), ("A", day(step_at + 2), 300.0)], "code string, date date, outstanding_shares double")
    acts = spark.createDataFrame([("A", day(k), r - 1, 0.0, None) for k, r in events], "code string, date date, bonus_ratio double, rights_ratio double, consideration_stock_ratio double")
    return dates, held, acts


def test_a_step_moves_to_the_price_jump(spark):
    rows = {r.date: r for r in cal.align_outstanding_shares(*shares(spark, jump_at=7)).collect()}
    assert [rows[day(k)].outstanding_shares for k in (6, 7, 9, 10, 12)] == [100, 200, 200, 200, 300]
    assert [k for k in range(30) if rows[day(k)].moved] == [7, 8, 9]


def test_each_step_is_used_once_and_in_order_of_events(spark):
    moves = cal.share_moves(*shares(spark, events=((8, 2.0), (9, 2.0), (14, 1.5)))).orderBy("seq").collect()
    assert [(m.source, m.effective, m.evidence) for m in moves] == [(10, 8, "corporate_action"), (12, 14, "corporate_action")]
    rows = {r.date: r.outstanding_shares for r in cal.align_outstanding_shares(*shares(spark, events=((8, 2.0), (9, 2.0), (14, 1.5)))).collect()}
    assert [rows[day(k)] for k in (7, 8, 11, 12, 13, 14)] == [100, 200, 200, 200, 200, 300]


def test_a_step_in_place_is_used_up_by_its_action(spark):
    moves = cal.share_moves(*shares(spark, events=((10, 2.0), (11, 2.0)))).collect()
    assert moves == []


def test_events_far_away_or_before_the_history_move_nothing(spark):
    assert cal.share_moves(*shares(spark, events=((1, 2.0), (25, 1.5), (-20, 2.0), (40, 2.0)))).count() == 0


def test_no_shares_give_null_shares(spark):
    dates, held, acts = shares(spark)
    rows = cal.align_outstanding_shares(dates, held.limit(0), acts).collect()
    assert len(rows) == 30 and all(r.outstanding_shares is None and not r.moved for r in rows)
