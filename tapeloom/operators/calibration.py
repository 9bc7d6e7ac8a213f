"""Calibration: prices of one source fitted to another, share counts moved to their events, missing closes rebuilt.

All work is per instrument. The anchors of a fit are arrays of at most a few dozen rows, or of one instrument's sessions; fits, holdout tests
and assignments are expressions over them, so a target never meets its anchors in a join of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import windows as w
from tapeloom.operators.joins import asof_join
from tapeloom.operators.quality import action_chain_affine, backward_adjust, first_reason

# Fixed value: words of an action that the chain can't express.
UNSUPPORTED_ACTIONS = ("拆成", "缩股", "合并", "换股")

EACH_SIDE = (5, 30)
NEAREST = 80
FACTOR_TOLERANCE = 1e-4
# Rows between a step of the shares and the event that explains it.
REACH = 5


def _sum(points: str, term: str) -> str:
    return f"aggregate({points}, 0D, (s, p) -> s + {term})"


def _line(df: DataFrame, points: str, name: str) -> DataFrame:
    """Add ``<name>_slope`` and ``<name>_base``: the least-squares line through an array of (x, y); of equal x the shortest solution."""
    mx, my = f"_{name}_mx", f"_{name}_my"
    out = df.selectExpr("*", f"try_divide({_sum(points, 'p.x')}, size({points})) AS {mx}", f"try_divide({_sum(points, 'p.y')}, size({points})) AS {my}")
    out = out.selectExpr(
        "*",
        f"{_sum(points, f'(p.x - {mx}) * (p.x - {mx})')} AS _{name}_xx",
        f"{_sum(points, f'(p.x - {mx}) * (p.y - {my})')} AS _{name}_xy",
    )
    out = out.selectExpr("*", f"CASE WHEN _{name}_xx > 1e-18D * {mx} * {mx} THEN _{name}_xy / _{name}_xx ELSE {mx} * {my} / ({mx} * {mx} + 1) END AS {name}_slope")
    return out.selectExpr("*", f"{my} - {name}_slope * {mx} AS {name}_base").drop(mx, my, f"_{name}_xx", f"_{name}_xy")


def affine_fit(df: DataFrame, points: str, least: int, max_error: float, max_relative: float, floor: float = 0.0, least_variation: float = 0.005) -> DataFrame:
    """Fit y = slope * x + intercept over the array ``points`` of (x, y) in their order, and judge it.

    Points without positive x and y are left out. A line through every other point is tested on the points between, and the line through all
    on all: no error may exceed ``max_error``, nor ``max_relative`` of y unless below ``floor``. Adds ``anchor_points``, ``variation``,
    ``slope``, ``intercept``, ``holdout_error``, ``fit_error`` and ``fit_status``; a rejected fit keeps its figures.
    """
    names = df.columns
    out = df.selectExpr("*", f"coalesce(filter({points}, p -> p.x > 0 AND p.y > 0), array()) AS _p")
    out = out.selectExpr("*", "filter(_p, (p, i) -> i % 2 = 0) AS _train", "filter(_p, (p, i) -> i % 2 = 1) AS _test", "array_sort(transform(_p, p -> p.x)) AS _x")
    out = _line(_line(out, "_train", "_half"), "_p", "_all")
    allowed = f"least({max_error}D, greatest({max_relative}D * p.y, {floor}D)) + 1e-12D"

    def worst(of: str, line: str) -> str:
        return f"array_max(transform({of}, p -> abs({line}_slope * p.x + {line}_base - p.y)))"

    def off(of: str, line: str) -> str:
        return f"exists({of}, p -> abs({line}_slope * p.x + {line}_base - p.y) > {allowed})"

    middle = "(get(_x, CAST(floor((size(_x) - 1) / 2) AS INT)) + get(_x, CAST(ceil((size(_x) - 1) / 2) AS INT))) / 2"
    out = out.selectExpr(
        *names,
        "CAST(size(_p) AS LONG) AS anchor_points",
        f"(get(_x, size(_x) - 1) - get(_x, 0)) / greatest(abs({middle}), 1e-12D) AS variation",
        "_all_slope AS slope",
        "_all_base AS intercept",
        f"{worst('_test', '_half')} AS holdout_error",
        f"{worst('_p', '_all')} AS fit_error",
        "size(_test) AS _tests",
        f"{off('_test', '_half')} OR {off('_p', '_all')} AS _off",
    )
    status = first_reason(
        ("insufficient_affine_anchors", f"anchor_points < {least}"),
        ("insufficient_affine_variation", f"variation < {least_variation}"),
        ("insufficient_holdout_anchors", "_tests < 2"),
        ("invalid_affine_slope", "NOT coalesce(slope > 0, false)"),
        ("unstable_affine", "_off"),
    )
    return out.selectExpr(*names, "anchor_points", "variation", "slope", "intercept", "holdout_error", "fit_error", f"coalesce({status}, 'stable_affine') AS fit_status")


def bracketed_transform(trusted: DataFrame, targets: DataFrame, each_side: tuple[int, int] = EACH_SIDE, tolerance: float = 0.011) -> DataFrame:
    """The affine map from raw to adjusted close around each target, proved by anchors on both of its sides.

    ``trusted`` holds (code, date, close_raw, close), one row a date; ``targets`` (code, date, close_raw, close_adjusted), the last possibly null.
    The anchors are the up to ``each_side[1]`` nearest before and after the date, at least ``each_side[0]`` on each; a row of the date itself
    is none. Anchors are numbered, and each target knows the numbers next to it, so its anchors are two frames of one sort by instrument.
    A known adjusted close must be met within ``tolerance``.
    """
    least, most = each_side
    anchors = trusted.filter("close_raw > 0 AND close > 0").selectExpr(
        "code", "date", "1 AS _k", "struct(date, close_raw AS x, close AS y) AS _a", "CAST(NULL AS DOUBLE) AS close_raw", "CAST(NULL AS DOUBLE) AS close_adjusted"
    )
    wanted = targets.selectExpr("code", "date", "0 AS _k", "CAST(NULL AS STRUCT<date: DATE, x: DOUBLE, y: DOUBLE>) AS _a", "close_raw", "close_adjusted")
    both = anchors.unionByName(wanted).selectExpr(
        "*",
        "CAST(count(_a) OVER (PARTITION BY code ORDER BY date, _k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS _low",
        "CAST(count(_a) OVER (PARTITION BY code ORDER BY date) AS INT) AS _peers",
    )
    both = both.selectExpr("*", "CASE WHEN _k = 1 THEN _low ELSE _peers END AS _high")
    both = both.selectExpr("*", f"collect_list(_a) OVER (PARTITION BY code ORDER BY _low RANGE BETWEEN {most - 1} PRECEDING AND CURRENT ROW) AS _before")
    both = both.selectExpr("*", f"collect_list(_a) OVER (PARTITION BY code ORDER BY _high RANGE BETWEEN 1 FOLLOWING AND {most} FOLLOWING) AS _after")
    framed = both.filter("_k = 0").selectExpr(
        "code", "date", "close_raw", "close_adjusted", "CAST(size(_before) AS LONG) AS before_points", "CAST(size(_after) AS LONG) AS after_points", "array_sort(concat(_before, _after)) AS _points"
    )
    fitted = affine_fit(framed, "_points", 2 * least, 0.00151, 0.0005, 0.00055)
    fitted = fitted.selectExpr("*", "abs(slope * close_raw + intercept - close_adjusted) AS target_error")
    status = first_reason(
        ("insufficient_side_anchors", f"before_points < {least} OR after_points < {least}"),
        ("rejected_fit", "fit_status <> 'stable_affine'"),
        ("target_mismatch", f"target_error > {tolerance}D + 1e-12D"),
    )
    return fitted.selectExpr("* EXCEPT (_points)", f"coalesce({status}, 'accepted') AS status")


def factor_matched_transform(anchors: DataFrame, targets: DataFrame, nearest: int = NEAREST, tolerance: float = FACTOR_TOLERANCE) -> DataFrame:
    """The affine map from raw to adjusted close, over the ``nearest`` anchors in time that have the target's legacy factor.

    ``anchors`` hold (code, date, close_legacy, close_raw, close_adjusted); ``targets`` the same and ``validation_raw``, the raw close to
    be tested on (null: close_raw). The factor is legacy over raw close, equal within ``tolerance``. Anchors go to the bins of
    the factor's logarithm that a target of equal factor can have, so targets meet the anchors of their bin only; a bin holds at most
    the sessions of one instrument. Equally distant anchors count in order of date. Targets without an adjusted close are not judged.
    """
    bin_of = f"CAST(floor(ln(try_divide(close_legacy, close_raw)) / {2 * tolerance}D) AS LONG)"
    held = anchors.filter("close_legacy > 0 AND close_raw > 0 AND close_adjusted > 0").selectExpr(
        "code", f"explode(array({bin_of} - 1, {bin_of}, {bin_of} + 1)) AS _bin", "struct(date, close_legacy / close_raw AS f, close_raw AS x, close_adjusted AS y) AS _a"
    )
    pools = held.groupBy("code", "_bin").agg(F.collect_list("_a").alias("_pool"))
    asked = targets.selectExpr("*", "try_divide(close_legacy, close_raw) AS factor", f"{bin_of} AS _bin")
    met = asked.join(pools, ["code", "_bin"], "left")
    equal = f"filter(coalesce(_pool, array()), a -> a.date <> date AND abs(a.f / factor - 1) <= {tolerance}D)"
    near = f"slice(array_sort(transform({equal}, a -> struct(abs(datediff(a.date, date)) AS days, a.date AS date, a.x AS x, a.y AS y))), 1, {nearest})"
    chosen = met.selectExpr("* EXCEPT (_bin, _pool)", f"array_sort(transform({near}, a -> struct(a.date, a.x, a.y))) AS _points")
    fitted = affine_fit(chosen, "_points", 8, 0.011, 0.0025)
    model = "greatest(fit_error, holdout_error)"
    fitted = fitted.selectExpr(
        "*",
        "abs(slope * coalesce(validation_raw, close_raw) + intercept - close_adjusted) AS target_error",
        f"CASE WHEN validation_raw IS NULL THEN 0.011D ELSE least(0.011D, 0.0051D + {model}) END AS target_tolerance",
    )
    status = first_reason(
        ("no_adjusted_close", "close_adjusted IS NULL"),
        ("no_anchor", "anchor_points = 0"),
        ("rejected_fit", "fit_status <> 'stable_affine'"),
        ("target_mismatch", "NOT coalesce(target_error <= target_tolerance + 1e-12D, false)"),
    )
    return fitted.selectExpr("* EXCEPT (_points)", f"coalesce({status}, 'accepted') AS status")


def action_calibration(trusted: DataFrame, actions: DataFrame, least: int = 20) -> DataFrame:
    """One affine map per instrument from closes chained through its actions to the committed closes, accepted where it is nearly the identity.

    ``actions`` hold (code, date, multiplier, additive, description); an action with an unusable multiplier or a description out of
    UNSUPPORTED_ACTIONS rejects the instrument. Actions of one date count in the order of multiplier and additive.
    """
    words = " OR ".join(f"contains(description, '{x}')" for x in UNSUPPORTED_ACTIONS)
    faults = actions.groupBy("code").agg(
        F.count(F.lit(1)).alias("actions"),
        F.expr(f"coalesce(bool_or({words}), false)").alias("_words"),
        F.expr("min(CASE WHEN NOT coalesce(multiplier > 0 AND multiplier < double('inf'), false) THEN date END)").alias("_bad"),
    )
    usable = actions.filter("multiplier > 0 AND multiplier < double('inf')")
    chain = action_chain_affine(usable.groupBy("code", "date").agg(F.expr(
        "aggregate(array_sort(collect_list(struct(multiplier, additive))), struct(1D AS m, 0D AS a), (s, x) -> struct(s.m * x.multiplier AS m, s.a + s.m * x.additive AS a))"
    ).alias("c")).selectExpr("code", "date", "c.m AS multiplier", "c.a AS additive"))
    rows = trusted.filter("close > 0 AND close_raw > 0").select("code", "date", "close_raw", "close")
    placed = asof_join(rows, chain.withColumnRenamed("date", "adate"), "code", "date", "adate", ["slope", "intercept"])
    points = placed.groupBy("code").agg(
        F.expr("array_sort(collect_list(struct(date, coalesce(slope, 1D) * close_raw + coalesce(intercept, 0D) AS x, close AS y)))").alias("_points"), F.max("date").alias("_last")
    )
    fitted = affine_fit(points.join(faults, "code", "left"), "_points", least, 0.002, 0.0002, 0.00055)
    status = first_reason(
        ("insufficient_rows", f"anchor_points < {least}"),
        ("unsupported_action", "_words"),
        ("invalid_multiplier", "_bad <= _last"),
        ("rejected_fit", "fit_status <> 'stable_affine'"),
        ("not_the_same_prices", "abs(slope - 1) > 0.005D OR abs(intercept) > 0.02D"),
    )
    return fitted.selectExpr(
        "code", "anchor_points", "slope AS base_slope", "intercept AS base_intercept", "holdout_error", "fit_error", "fit_status",
        "coalesce(actions, 0L) AS actions", f"coalesce({status}, 'accepted') AS status",
    )


def calibrate_scale(anchors: DataFrame, fetched: DataFrame, relative: float = 1e-3, absolute: float = 0.011, least: int = 3, share: float = 0.8) -> DataFrame:
    """Median ratio of committed to fetched values per key, accepted if enough requested anchors came back and all of them agree.

    ``anchors`` hold (code, date, committed), ``fetched`` (code, date, value). At least ``least`` anchors and ``share`` of those requested must
    have a value, and each value times the scale must be within ``absolute`` and ``relative`` of the committed one.
    """
    rows = anchors.select("code", "date", "committed").join(fetched.select("code", "date", "value"), ["code", "date"], "left")
    scale = rows.groupBy("code").agg(F.expr("percentile(CASE WHEN value > 0 AND value < double('inf') THEN committed / value END, 0.5)").alias("scale"))
    held = rows.join(scale, "code").selectExpr("*", "value * scale AS _c")
    near = f"abs(_c - committed) <= {absolute}D + {relative}D * abs(committed)"
    out = held.groupBy("code").agg(
        F.count(F.lit(1)).alias("requested"),
        F.count("value").alias("available"),
        F.expr("CASE WHEN max(scale) > 0 THEN max(scale) END").alias("scale"),
        F.expr("max(abs(try_divide(_c, committed) - 1))").alias("max_error"),
        F.expr(f"bool_and(value IS NULL OR coalesce({near}, false))").alias("_near"),
    )
    required = f"greatest({least}, ceil(requested * {share}D))"
    return out.selectExpr(
        "code", "requested", "available", f"CAST({required} AS LONG) AS required", "scale", "max_error",
        f"coalesce(requested >= {least} AND available >= {required} AND scale > 0 AND _near, false) AS passed",
    )


def _steps(dates: DataFrame, shares: DataFrame) -> DataFrame:
    """Rows with their number, the shares known then, and the step from the row before."""
    valid = shares.filter("outstanding_shares > 0").select("code", F.col("date").alias("_since"), F.col("outstanding_shares").alias("held"))
    rows = asof_join(dates.select("code", "date", "close", "close_raw"), valid, "code", "date", "_since", ["held"]).drop("asof_time")
    mechanical = f"try_divide(try_divide(close, {w.ref('close')}), try_divide(close_raw, {w.ref('close_raw')}))"
    return rows.selectExpr("code", "date", "held", f"CAST({w.ROW_INDEX} - 1 AS INT) AS idx", f"{w.ref('held')} AS _old", f"{mechanical} AS mechanical").selectExpr(
        "code", "date", "held", "idx", "mechanical", "CASE WHEN held <> _old THEN named_struct('idx', idx, 'old', _old, 'new', held, 'ratio', held / _old) END AS step"
    )


MOVE = "struct<seq: int, source: int, effective: int, old: double, new: double, expected: double, observed: double, evidence: string>"


def share_moves(dates: DataFrame, shares: DataFrame, actions: DataFrame, reach: int = REACH, tolerance: float = 0.03) -> DataFrame:
    """(code, seq, source, effective, old, new, expected, observed, evidence): which steps of the shares belong to another row.

    First by price: of the rows within ``reach`` of a step of 3% or more, one whose adjusted and raw returns differ by the step's ratio; least error
    wins, then the nearer, then the earlier row. Then by action: for each date of actions in order, the step within ``reach`` rows of its
    first session whose ratio agrees; each step is used once. Rows are numbered from 0 by instrument. Steps that are where they belong
    are used up by an action, but not by a price, and are no moves. The assignment folds over one instrument's actions.
    """
    rows = _steps(dates, shares)
    around = f"collect_list(CASE WHEN mechanical > 0 AND abs(mechanical - 1) >= 0.02D THEN struct(idx, mechanical AS m) END) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)"
    near = "filter(_near, c -> abs(c.m / step.ratio - 1) <= {t}D)".format(t=tolerance)
    best = f"array_min(transform({near}, c -> struct(abs(c.m / step.ratio - 1) AS error, abs(c.idx - step.idx) AS away, c.idx AS idx, c.m AS m)))"
    judged = rows.selectExpr("*", f"{around} AS _near").filter("step IS NOT NULL").selectExpr(
        "code", "step", f"CASE WHEN abs(step.ratio - 1) >= 0.03D THEN {best} END AS _b"
    )
    moved = judged.selectExpr(
        "code", "step",
        "CASE WHEN _b.idx <> step.idx THEN named_struct('seq', step.idx, 'source', step.idx, 'effective', _b.idx, 'old', step.old, 'new', step.new, "
        "'expected', step.ratio, 'observed', _b.m, 'evidence', 'price_discontinuity') END AS move",
    )
    steps = moved.groupBy("code").agg(
        F.expr("array_sort(collect_list(step))").alias("steps"),
        F.expr("array_sort(collect_list(move))").alias("moves"),
    )
    each = "(1 + coalesce(bonus_ratio, 0D) + coalesce(rights_ratio, 0D) + coalesce(consideration_stock_ratio, 0D))"
    events = actions.groupBy("code", "date").agg(F.expr(f"aggregate(array_sort(collect_list({each})), 1D, (s, x) -> s * x)").alias("expected"))
    both = rows.selectExpr("code", "date", "1 AS k", "idx", "CAST(NULL AS DOUBLE) AS expected").unionByName(events.selectExpr("code", "date", "0 AS k", "CAST(NULL AS INT) AS idx", "expected"))
    placed = both.selectExpr(
        "*",
        f"last(idx, true) {w.running('code', 'date DESC, k DESC')} AS effective",
        "min(CASE WHEN k = 1 THEN date END) OVER (PARTITION BY code) AS _first",
    ).filter("k = 0 AND effective IS NOT NULL AND date >= date_sub(_first, 7) AND abs(expected - 1) >= 0.005D")
    per_code = placed.groupBy("code").agg(F.expr("array_sort(collect_list(struct(date, effective, expected)))").alias("events"))
    fits = f"t -> NOT array_contains(s.used, t.idx) AND abs(t.idx - e.effective) <= {reach} AND abs(t.ratio / e.expected - 1) <= {tolerance}D"
    found = f"array_min(transform(filter(steps, {fits}), t -> struct(abs(t.ratio / e.expected - 1) AS error, abs(t.idx - e.effective) AS away, t.idx AS idx, t.old AS old, t.new AS new, t.ratio AS ratio)))"
    move = (
        "named_struct('seq', 1000000000 + size(s.moves), 'source', b.idx, 'effective', e.effective, 'old', b.old, 'new', b.new, "
        "'expected', e.expected, 'observed', b.ratio, 'evidence', 'corporate_action')"
    )
    step = f"get(transform(array({found}), b -> CASE WHEN b IS NULL THEN s ELSE named_struct('used', concat(s.used, array(b.idx)), 'moves', concat(s.moves, array({move}))) END), 0)"
    start = f"named_struct('used', transform(moves, m -> m.source), 'moves', CAST(array() AS ARRAY<{MOVE}>))"
    assigned = steps.join(per_code, "code", "left").selectExpr(
        "code", "moves", f"aggregate(coalesce(events, array()), {start}, (s, e) -> {step}).moves AS by_action"
    )
    return assigned.selectExpr("code", "inline(concat(moves, filter(by_action, m -> m.source <> m.effective)))")


def align_outstanding_shares(dates: DataFrame, shares: DataFrame, actions: DataFrame, reach: int = REACH, tolerance: float = 0.03) -> DataFrame:
    """(code, date, outstanding_shares, moved) of every session: the shares known then, with the steps at the rows that ``share_moves`` finds.

    ``dates`` hold (code, date, close, close_raw), ``shares`` (code, date, outstanding_shares), one row a date in both; ``actions`` (code, date, bonus_ratio,
    rights_ratio, consideration_stock_ratio). Where moves overlap the later one counts, actions after prices.
    """
    moves = share_moves(dates, shares, actions, reach, tolerance)
    spans = moves.selectExpr(
        "code", "seq", "CASE WHEN source < effective THEN old ELSE new END AS value",
        "explode(sequence(least(source, effective), greatest(source, effective) - 1)) AS idx",
    )
    last = spans.groupBy("code", "idx").agg(F.max_by("value", "seq").alias("value"))
    rows = _steps(dates, shares).select("code", "date", "idx", "held")
    return rows.join(last, ["code", "idx"], "left").selectExpr("code", "date", "coalesce(value, held) AS outstanding_shares", "value IS NOT NULL AS moved")


def reconstruct_missing_close(
    current: DataFrame, missing: DataFrame, actions: DataFrame, least: int = 20, p99: float = 0.002, most: float = 0.02, leading: float = 0.002
) -> DataFrame:
    """Adjusted closes of ``missing`` bars from raw prices and actions, at a scale proved on committed rows.

    ``current`` holds (code, date, close, close_raw), ``missing`` (code, date, open_raw, high_raw, low_raw, close_raw); dates that ``current`` has are not
    missing. Raw closes of both are adjusted by the actions; the scale is the median ratio of committed to rebuilt closes if the 99% quantile and the
    largest deviation from it stay within ``p99`` and ``most``. Otherwise, if all missing bars come before the first committed one and no action does, it
    is the median of the first ``least`` ratios if none of these deviates by more than ``leading``. Without a scale, or with a raw price missing,
    no row of the instrument is rebuilt. Gives (code, date, close, method, scale, reason) of every missing bar.
    """
    gone = missing.join(current.select("code", "date"), ["code", "date"], "left_anti")
    prices = ("open_raw", "high_raw", "low_raw", "close_raw")
    usable = " AND ".join(f"coalesce({c} > 0 AND {c} < double('inf'), false)" for c in prices)
    asked = gone.groupBy("code").agg(F.max("date").alias("_last_gone"), F.expr(f"bool_and({usable})").alias("_priced"))
    finite = "close > 0 AND close < double('inf') AND close_raw > 0 AND close_raw < double('inf')"
    held = current.filter(finite).selectExpr("code", "date", "close_raw", "close AS committed")
    raw = held.selectExpr("code", "date", "committed", "close_raw AS close").unionByName(
        gone.filter(usable).selectExpr("code", "date", "CAST(NULL AS DOUBLE) AS committed", "close_raw AS close")
    )
    raw = raw.selectExpr("code", "date", "committed", "close AS open", "close AS high", "close AS low", "close")
    built = backward_adjust(raw, actions).selectExpr("code", "date", "committed", "close", "try_divide(committed, close) AS ratio")
    built = built.selectExpr("code", "date", "committed", "close", "CASE WHEN ratio > 0 AND ratio < double('inf') THEN ratio END AS ratio")
    per_code = built.filter("committed IS NOT NULL").groupBy("code").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("date").alias("_start"),
        F.expr("transform(array_sort(collect_list(CASE WHEN ratio IS NOT NULL THEN struct(date, ratio) END)), x -> x.ratio)").alias("_r"),
        F.percentile("ratio", F.lit(0.5)).alias("_full"),
    )

    def middle(a: str) -> str:
        return f"(get({a}, CAST(floor((size({a}) - 1) / 2) AS INT)) + get({a}, CAST(ceil((size({a}) - 1) / 2) AS INT))) / 2"

    early = actions.join(per_code.select("code", "_start"), "code").filter("date <= _start").groupBy("code").agg(F.count(F.lit(1)).alias("_early"))
    audit = asked.join(per_code, "code", "left").join(early, "code", "left")
    audit = audit.selectExpr("*", "array_sort(transform(_r, x -> abs(x / _full - 1))) AS _e", f"array_sort(slice(_r, 1, {least})) AS _head")
    audit = audit.selectExpr("*", f"{middle('_head')} AS _lead")
    # Linear interpolation between the two ranks around the quantile.
    at = "(size(_e) - 1) * 0.99D"
    low, high = f"get(_e, CAST(floor({at}) AS INT))", f"get(_e, CAST(ceil({at}) AS INT))"
    audit = audit.selectExpr(
        "*",
        f"{low} + ({at} - floor({at})) * ({high} - {low}) AS _p99",
        "array_max(_e) AS _most",
        "array_max(transform(_head, x -> abs(x / _lead - 1))) AS _lead_most",
    )
    reason = first_reason(
        ("insufficient_committed_overlap", f"coalesce(_rows, 0) < {least}"), ("missing_raw_price", "NOT _priced"), ("insufficient_valid_overlap", f"size(_r) < {least}")
    )
    full = f"_p99 <= {p99} AND _most <= {most}"
    prefix = f"_last_gone < _start AND coalesce(_early, 0) = 0 AND _lead_most <= {leading}"
    audit = audit.selectExpr("*", f"{reason} AS _reason").selectExpr(
        "code", f"CASE WHEN _reason IS NOT NULL THEN NULL WHEN {full} THEN 'full_overlap_stable_scale' WHEN {prefix} THEN 'clean_pre_action_prefix' END AS method", "_reason", "_full", "_lead"
    )
    audit = audit.selectExpr(
        "code", "method", "CASE method WHEN 'full_overlap_stable_scale' THEN _full WHEN 'clean_pre_action_prefix' THEN _lead END AS scale",
        "CASE WHEN method IS NULL THEN coalesce(_reason, 'adjustment_scale_not_proven') END AS reason",
    )
    rebuilt = built.filter("committed IS NULL").select("code", "date", F.col("close").alias("_close"))
    return gone.select("code", "date").join(rebuilt, ["code", "date"], "left").join(audit, "code").selectExpr("code", "date", "_close * scale AS close", "method", "scale", "reason")
