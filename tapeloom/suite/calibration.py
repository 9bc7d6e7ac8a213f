"""Calibration of prices and shares between sources (Q11, Q24, Q25, Q36, Q37, Q39)."""

from __future__ import annotations

import re

from tapeloom.operators import calibration as cal
from tapeloom.operators import quality as q
from tapeloom.suite.common import bars, out
from tapeloom.suite.quality import ACT, HS, H, _actions
from tapeloom.suite.sqlbase import ALL, S, cte, r, sql

QUERIES, ORACLES = {}, {}


def doubles(text: str) -> str:
    """The expression with numbers such as 0.5D as DuckDB writes them."""
    return re.sub(r"(\d)D\b", r"\1::DOUBLE", text)


# The committed close is an affine map of the raw one that changes every third year; some rows are a little off, and every fifth
# instrument is off by more than any fit allows. Rows by h are missing and become targets.
SEGMENT = "(1 + 0.5D * (CAST(floor(year(date) / 3) AS INT) % 3))"
ADJUSTED = f"close_raw * {SEGMENT} + 0.2D * (CAST(floor(year(date) / 3) AS INT) % 2) + CASE WHEN h % 7 = 1 THEN 0.001D WHEN CAST(code AS INT) % 5 = 0 AND h % 7 = 2 THEN 0.05D ELSE 0 END"
STRAIGHT = ADJUSTED.split(" + CASE")[0]


def _sourced(spark, d):
    return bars(spark, d).selectExpr("*", f"{H} AS h").selectExpr("code", "date", "h", "close_raw", f"{ADJUSTED} AS adjusted", f"{STRAIGHT} AS straight")


def bracketed_transform(spark, d):
    b = _sourced(spark, d)
    trusted = b.filter("h % 9 <> 0").selectExpr("code", "date", "close_raw", "adjusted AS close")
    targets = b.filter("h % 9 = 0").selectExpr("code", "date", "close_raw", "CASE h % 4 WHEN 0 THEN straight + 0.02D WHEN 1 THEN CAST(NULL AS DOUBLE) ELSE straight END AS close_adjusted")
    return out(cal.bracketed_transform(trusted, targets), "code date before_points after_points anchor_points variation slope intercept holdout_error fit_error fit_status target_error status")


SQL_FIT = """
SELECT *, CASE WHEN n < {least} THEN 'insufficient_affine_anchors' WHEN variation < 0.005 THEN 'insufficient_affine_variation' WHEN tests < 2 THEN 'insufficient_holdout_anchors'
  WHEN NOT coalesce(slope > 0, false) THEN 'invalid_affine_slope' WHEN off THEN 'unstable_affine' ELSE 'stable_affine' END AS fit_status FROM (
SELECT {keys}, count(x) AS n, count(x) FILTER (k % 2 = 0) AS tests, (max(x) - min(x))/greatest(abs(median(x)), 1e-12) AS variation, any_value(s) AS slope, any_value(b) AS intercept,
  max(abs(s*x + b - y)) AS fit_error, max(abs(hs*x + hb - y)) FILTER (k % 2 = 0) AS holdout_error,
  coalesce(bool_or(abs(s*x + b - y) > least({error}, greatest({relative}*y, {floor})) + 1e-12 OR (k % 2 = 0 AND abs(hs*x + hb - y) > least({error}, greatest({relative}*y, {floor})) + 1e-12)), false) AS off
FROM (SELECT *, regr_slope(y, x) OVER g AS s, regr_intercept(y, x) OVER g AS b, regr_slope(CASE WHEN k % 2 = 1 THEN y END, x) OVER g AS hs, regr_intercept(CASE WHEN k % 2 = 1 THEN y END, x) OVER g AS hb
  FROM (SELECT *, CASE WHEN x IS NOT NULL THEN row_number() OVER (PARTITION BY {keys} ORDER BY adate) END AS k FROM ({points})) WINDOW g AS (PARTITION BY {keys})) GROUP BY {keys})"""

cte(
    "sourced",
    doubles(f"SELECT code, date, h, close_raw, {ADJUSTED} AS adjusted, {STRAIGHT} AS straight FROM (SELECT *, {HS} AS h FROM bars)"),
    "bars",
)
cte(
    "bracketed",
    SQL_FIT.format(
        least=10, error="0.00151", relative="0.0005", floor="0.00055", keys="code, date",
        points="""SELECT t.code, t.date, a.date AS adate, CASE WHEN rb <= 30 OR ra <= 30 THEN a.close_raw END AS x, a.adjusted AS y FROM sourced t
  LEFT JOIN (SELECT t.code, t.date AS tdate, a.date, a.close_raw, a.adjusted, CASE WHEN a.date < t.date THEN row_number() OVER (PARTITION BY t.code, t.date, a.date < t.date ORDER BY a.date DESC) END AS rb,
    CASE WHEN a.date > t.date THEN row_number() OVER (PARTITION BY t.code, t.date, a.date > t.date ORDER BY a.date) END AS ra
    FROM sourced t JOIN sourced a ON a.code = t.code AND a.h % 9 <> 0 AND a.date <> t.date WHERE t.h % 9 = 0) a ON a.code = t.code AND a.tdate = t.date AND (rb <= 30 OR ra <= 30) WHERE t.h % 9 = 0""",
    ),
    "sourced",
)

QUERIES["bracketed_transform"] = bracketed_transform
ORACLES["bracketed_transform"] = sql(
    f"""SELECT code, date, before_points, after_points, n AS anchor_points, {r('variation slope intercept holdout_error fit_error')}, fit_status, {r('target_error')},
CASE WHEN before_points < 5 OR after_points < 5 THEN 'insufficient_side_anchors' WHEN fit_status <> 'stable_affine' THEN 'rejected_fit' WHEN target_error > 0.011 + 1e-12 THEN 'target_mismatch' ELSE 'accepted' END AS status FROM (
SELECT f.*, abs(f.slope*t.close_raw + f.intercept - CASE t.h % 4 WHEN 0 THEN straight + 0.02 WHEN 1 THEN NULL ELSE straight END) AS target_error,
  least(30, (SELECT count(*) FROM sourced a WHERE a.code = f.code AND a.h % 9 <> 0 AND a.date < f.date)) AS before_points, least(30, (SELECT count(*) FROM sourced a WHERE a.code = f.code AND a.h % 9 <> 0 AND a.date > f.date)) AS after_points
FROM bracketed f JOIN sourced t USING (code, date))""",
    "bracketed",
)

# Legacy closes follow the raw ones by a factor that takes four values, with noise within the tolerance.
FACTOR = "(1 + 0.25D * (CAST(floor(month(date) / 4) AS INT))) * (1 + 0.00001D * (h % 7))"
MATCHED = "CASE WHEN CAST(code AS INT) % 6 = 0 AND h % 11 = 3 THEN 0.2D ELSE 0 END + close_raw * (1.1D + 0.25D * (CAST(floor(month(date) / 4) AS INT))) + 0.3D"


def factor_matched_transform(spark, d):
    b = bars(spark, d).selectExpr("*", f"{H} AS h").selectExpr("code", "date", "h", "close_raw", f"close_raw * {FACTOR} AS close_legacy", f"{MATCHED} AS close_adjusted")
    targets = b.filter("h % 8 = 0").selectExpr(
        "code", "date", "close_legacy", "close_raw", "CASE h % 3 WHEN 0 THEN close_raw + 0.002D WHEN 1 THEN close_raw + 0.5D END AS validation_raw", "CASE WHEN h % 5 <> 4 THEN close_adjusted END AS close_adjusted"
    )
    return out(cal.factor_matched_transform(b, targets), "code date factor anchor_points variation slope intercept holdout_error fit_error fit_status target_error target_tolerance status")


cte(
    "matched",
    doubles(f"SELECT code, date, h, close_raw, close_raw * {FACTOR} AS close_legacy, {MATCHED} AS close_adjusted FROM (SELECT *, {HS} AS h FROM bars)"),
    "bars",
)
cte(
    "matched_fit",
    SQL_FIT.format(
        least=8, error="0.011", relative="0.0025", floor="0.0", keys="code, date",
        points="""SELECT t.code, t.date, a.date AS adate, a.close_raw AS x, a.close_adjusted AS y FROM matched t LEFT JOIN (
  SELECT t.code, t.date AS tdate, a.date, a.close_raw, a.close_adjusted FROM matched t JOIN matched a ON a.code = t.code AND a.date <> t.date AND abs((a.close_legacy/a.close_raw)/(t.close_legacy/t.close_raw) - 1) <= 0.0001
  WHERE t.h % 8 = 0 QUALIFY row_number() OVER (PARTITION BY t.code, t.date ORDER BY abs(a.date - t.date), a.date) <= 80) a ON a.code = t.code AND a.tdate = t.date WHERE t.h % 8 = 0""",
    ),
    "matched",
)
QUERIES["factor_matched_transform"] = factor_matched_transform
ORACLES["factor_matched_transform"] = sql(
    f"""SELECT code, date, {r('factor')}, n AS anchor_points, {r('variation slope intercept holdout_error fit_error')}, fit_status, {r('target_error target_tolerance')},
CASE WHEN adj IS NULL THEN 'no_adjusted_close' WHEN n = 0 THEN 'no_anchor' WHEN fit_status <> 'stable_affine' THEN 'rejected_fit' WHEN NOT coalesce(target_error <= target_tolerance + 1e-12, false) THEN 'target_mismatch' ELSE 'accepted' END AS status FROM (
SELECT *, abs(slope*coalesce(v, raw) + intercept - adj) AS target_error, CASE WHEN v IS NULL THEN 0.011 ELSE least(0.011, 0.0051 + greatest(fit_error, holdout_error)) END AS target_tolerance FROM (
SELECT f.*, t.close_raw AS raw, t.close_legacy/t.close_raw AS factor, CASE WHEN t.h % 5 <> 4 THEN t.close_adjusted END AS adj, CASE t.h % 3 WHEN 0 THEN t.close_raw + 0.002 WHEN 1 THEN t.close_raw + 0.5 END AS v FROM matched_fit f JOIN matched t USING (code, date)))""",
    "matched_fit",
)


# Actions of every sixteenth row; the chain of an even instrument is the one its closes were made with.
def _chain(spark, d):
    return bars(spark, d).selectExpr("*", f"{H} AS h").filter("h % 16 = 0").selectExpr(
        "code", "date", "CASE WHEN CAST(code AS INT) % 7 = 3 AND h % 64 = 0 THEN -1D ELSE 1 + 0.01D * (h % 5) END AS multiplier", "0.1D * (h % 3) AS additive",
        "CASE WHEN CAST(code AS INT) % 11 = 5 AND h % 64 = 0 THEN '10股缩股为5股' ELSE 'cash' END AS description",
    )


def action_calibration(spark, d):
    from tapeloom.operators.joins import asof_join

    acts = _chain(spark, d)
    own = q.action_chain_affine(acts.filter("multiplier > 0").select("code", "date", "multiplier", "additive")).withColumnRenamed("date", "adate")
    b = asof_join(bars(spark, d).select("code", "date", "close_raw"), own, "code", "date", "adate", ["slope", "intercept"])
    rows = b.selectExpr("code", "date", "close_raw", "coalesce(slope, 1D) * close_raw + coalesce(intercept, 0D) + CASE WHEN CAST(code AS INT) % 4 = 1 THEN 0.01D * month(date) WHEN CAST(code AS INT) % 4 = 2 THEN 0.05D ELSE 0 END AS close")
    return out(cal.action_calibration(rows, acts), "*")


cte(
    "chained",
    f"""SELECT code, date, multiplier, additive, description, product(CASE WHEN multiplier > 0 THEN multiplier ELSE 1 END) OVER {ALL} AS slope FROM (
SELECT code, date, CASE WHEN CAST(code AS INT) % 7 = 3 AND h % 64 = 0 THEN -1 ELSE 1 + 0.01 * (h % 5) END::DOUBLE AS multiplier, (0.1 * (h % 3))::DOUBLE AS additive,
  CASE WHEN CAST(code AS INT) % 11 = 5 AND h % 64 = 0 THEN '10股缩股为5股' ELSE 'cash' END AS description FROM (SELECT *, {HS} AS h FROM bars) WHERE h % 16 = 0)""",
    "bars",
)
cte(
    "canonical",
    f"""SELECT b.code, b.date, coalesce(c.slope, 1) * b.close_raw + coalesce(c.intercept, 0) AS x FROM bars b ASOF LEFT JOIN (
SELECT code, date, slope, sum(CASE WHEN multiplier > 0 THEN additive * before ELSE 0 END) OVER {ALL} AS intercept FROM (SELECT *, coalesce(lag(slope) OVER {S}, 1) AS before FROM chained)) c ON c.code = b.code AND b.date >= c.date""",
    "bars",
    "chained",
)
cte(
    "chain_fit",
    SQL_FIT.format(
        least=20, error="0.002", relative="0.0002", floor="0.00055", keys="code",
        points="SELECT code, date AS adate, x, x + CASE WHEN CAST(code AS INT) % 4 = 1 THEN 0.01 * month(date) WHEN CAST(code AS INT) % 4 = 2 THEN 0.05 ELSE 0 END::DOUBLE AS y FROM canonical",
    ),
    "canonical",
)
QUERIES["action_calibration"] = action_calibration
ORACLES["action_calibration"] = sql(
    f"""SELECT code, n AS anchor_points, {r('base_slope base_intercept holdout_error fit_error')}, fit_status, coalesce(actions, 0) AS actions,
CASE WHEN n < 20 THEN 'insufficient_rows' WHEN words THEN 'unsupported_action' WHEN bad <= last THEN 'invalid_multiplier' WHEN fit_status <> 'stable_affine' THEN 'rejected_fit' WHEN abs(base_slope - 1) > 0.005 OR abs(base_intercept) > 0.02 THEN 'not_the_same_prices' ELSE 'accepted' END AS status FROM (
SELECT f.*, slope AS base_slope, intercept AS base_intercept, a.* EXCLUDE (code), l.last FROM chain_fit f LEFT JOIN (SELECT code, count(*) AS actions, bool_or(contains(description, '缩股')) AS words, min(date) FILTER (multiplier <= 0) AS bad FROM chained GROUP BY code) a ON a.code = f.code
JOIN (SELECT code, max(date) AS last FROM bars GROUP BY code) l ON l.code = f.code)""",
    "chain_fit",
)


def calibrated_scale(spark, d):
    b = bars(spark, d).selectExpr("code", "date", "close", f"{H} AS h").filter("h % 5 = 0")
    fetched = b.filter("h % 15 <> 5 AND (CAST(code AS INT) % 4 <> 1 OR h % 10 = 0)").selectExpr(
        "code", "date", "CASE WHEN CAST(code AS INT) % 3 = 1 AND h % 35 = 0 THEN close / 1.9D ELSE close / 2 * (1 + 0.0001D * (h % 4)) END AS value"
    )
    return out(cal.calibrate_scale(b.selectExpr("code", "date", "close AS committed"), fetched, share=0.6), "*")


QUERIES["calibrated_scale"] = calibrated_scale
ORACLES["calibrated_scale"] = sql(
    f"""SELECT code, requested, available, required, {r('scale max_error')}, CAST(coalesce(requested >= 3 AND available >= required AND scale > 0 AND near, false) AS INT) AS passed FROM (
SELECT code, count(*) AS requested, count(v) AS available, CAST(greatest(3, ceil(count(*)*0.6::DOUBLE)) AS BIGINT) AS required, any_value(m) AS scale, max(abs(v*m/close - 1)) AS max_error, bool_and(v IS NULL OR coalesce(abs(v*m - close) <= 0.011 + 0.001*abs(close), false)) AS near FROM (
SELECT *, median(close/v) OVER (PARTITION BY code) AS m FROM (SELECT code, close, CASE WHEN h % 15 <> 5 AND (CAST(code AS INT) % 4 <> 1 OR h % 10 = 0) THEN CASE WHEN CAST(code AS INT) % 3 = 1 AND h % 35 = 0 THEN close/1.9 ELSE close/2*(1 + 0.0001*(h % 4)) END END AS v
FROM (SELECT *, {HS} AS h FROM bars) WHERE h % 5 = 0)) GROUP BY code)""",
    "bars",
)


# Shares step every twenty rows. Where the code is even, raw prices jump by the step's ratio a few rows away; elsewhere actions with that ratio lie a few rows away.
LEVEL = "(1 + (CAST(floor(({i}) / 20) AS INT) + CAST(code AS INT)) % 4)"
SHIFT = "((CAST(code AS INT) + {i}) % 9 - 4)"


def _shared(spark, d):
    from tapeloom.functions import windows as w

    rows = bars(spark, d).selectExpr("code", "date", "close", f"{w.ROW_INDEX} - 1 AS i")
    late = f"greatest(0, i - (CAST(code AS INT) % 9 - 4))"
    return rows.selectExpr(
        "code", "date", "close", "i", f"1000D * {LEVEL.format(i='i')} AS outstanding_shares", f"CASE WHEN CAST(code AS INT) % 2 = 0 THEN close / {LEVEL.format(i=late)} ELSE close END AS close_raw"
    )


def _share_tables(spark, d):
    rows = _shared(spark, d)
    acts = rows.filter("i > 5 AND (i + CAST(code AS INT) % 4) % 20 = 0 OR i % 37 = 30").selectExpr(
        "code", "date_sub(date, 2) AS date",
        f"{LEVEL.format(i='i + CAST(code AS INT) % 4')} / CAST({LEVEL.format(i='i + CAST(code AS INT) % 4 - 20')} AS DOUBLE) - 1 AS bonus_ratio", "0D AS rights_ratio", "CASE WHEN i % 3 = 0 THEN 0.01D ELSE 0D END AS consideration_stock_ratio",
    )
    return rows.select("code", "date", "close", "close_raw"), rows.filter("i % 4 = 0").selectExpr("code", "date_sub(date, 1) AS date", "outstanding_shares"), acts


def share_moves(spark, d):
    moves = cal.share_moves(*_share_tables(spark, d))
    return out(moves.drop("seq").withColumnsRenamed({"old": "old_shares", "new": "new_shares"}), "*")


def aligned_shares(spark, d):
    return out(cal.align_outstanding_shares(*_share_tables(spark, d)), "*")


_LATE = "greatest(0, i - (CAST(code AS INT) % 9 - 4))"
cte(
    "shared",
    f"SELECT code, date, close, i, 1000.0::DOUBLE * {LEVEL.format(i='i')} AS outstanding_shares, CASE WHEN CAST(code AS INT) % 2 = 0 THEN close / {LEVEL.format(i=_LATE)} ELSE close END AS close_raw FROM (SELECT *, row_number() OVER {S} - 1 AS i FROM bars)",
    "bars",
)
cte(
    "share_rows",
    f"""SELECT *, lag(held) OVER {S} AS old, (close/lag(close) OVER {S}) / (close_raw/lag(close_raw) OVER {S}) AS mech FROM (
SELECT s.code, s.date, s.i, s.close, s.close_raw, k.outstanding_shares AS held FROM shared s ASOF LEFT JOIN (SELECT code, date - 1 AS date, outstanding_shares FROM shared WHERE i % 4 = 0) k ON k.code = s.code AND s.date >= k.date)""",
    "shared",
)
cte("share_steps", "SELECT code, i, old, held AS new, held/old AS ratio FROM share_rows WHERE old IS NOT NULL AND held <> old", "share_rows")
cte(
    "price_moves",
    """SELECT s.code, s.i AS source, c.i AS effective, s.old, s.new, s.ratio AS expected, c.mech AS observed FROM share_steps s JOIN share_rows c ON c.code = s.code AND abs(c.i - s.i) <= 5
WHERE c.mech > 0 AND abs(c.mech - 1) >= 0.02 AND abs(s.ratio - 1) >= 0.03 AND abs(c.mech/s.ratio - 1) <= 0.03 QUALIFY row_number() OVER (PARTITION BY s.code, s.i ORDER BY abs(c.mech/s.ratio - 1), abs(c.i - s.i), c.i) = 1""",
    "share_steps",
)
cte(
    "share_events",
    f"""SELECT code, date, expected, min(i) AS eff, row_number() OVER (PARTITION BY code ORDER BY date) AS k FROM (SELECT a.code, a.date, a.expected, b.i FROM (
SELECT code, date - 2 AS date, 1 + ({LEVEL.format(i='i + CAST(code AS INT) % 4')} / CAST({LEVEL.format(i='i + CAST(code AS INT) % 4 - 20')} AS DOUBLE) - 1) + 0.0::DOUBLE + CASE WHEN i % 3 = 0 THEN 0.01 ELSE 0 END::DOUBLE AS expected FROM shared WHERE i > 5 AND (i + CAST(code AS INT) % 4) % 20 = 0 OR i % 37 = 30) a
JOIN shared b ON b.code = a.code AND b.date >= a.date WHERE abs(expected - 1) >= 0.005 AND a.date >= (SELECT min(date) FROM shared z WHERE z.code = a.code) - 7) GROUP BY code, date, expected""",
    "shared",
)
cte(
    "taken",
    """SELECT code, 0::BIGINT AS k, coalesce(list(source) FILTER (source <> effective), []) AS used, NULL::BIGINT AS source, NULL::BIGINT AS eff, NULL::DOUBLE AS expected FROM (SELECT DISTINCT code FROM share_events) LEFT JOIN price_moves USING (code) GROUP BY code
UNION ALL SELECT /*step*/ t.code, e.k, CASE WHEN m.i IS NULL THEN t.used ELSE list_append(t.used, m.i) END, m.i, e.eff, e.expected FROM taken t JOIN share_events e ON e.code = t.code AND e.k = t.k + 1
LEFT JOIN LATERAL (SELECT s.i FROM share_steps s WHERE s.code = t.code AND NOT list_contains(t.used, s.i) AND abs(s.i - e.eff) <= 5 AND abs(s.ratio/e.expected - 1) <= 0.03 ORDER BY abs(s.ratio/e.expected - 1), abs(s.i - e.eff), s.i LIMIT 1) m ON true""",
    "share_events",
    "price_moves",
)
cte(
    "all_moves",
    """SELECT code, source AS seq, source, effective, old, new, expected, observed, 'price_discontinuity' AS evidence FROM price_moves WHERE source <> effective
UNION ALL SELECT t.code, 1000000 + t.k, s.i, t.eff, s.old, s.new, t.expected, s.ratio, 'corporate_action' FROM taken t JOIN share_steps s ON s.code = t.code AND s.i = t.source WHERE t.eff <> s.i""",
    "taken",
)
QUERIES["share_moves"] = share_moves
ORACLES["share_moves"] = sql(f"SELECT code, CAST(source AS INT) AS source, CAST(effective AS INT) AS effective, round(old, 6) AS old_shares, round(new, 6) AS new_shares, {r('expected observed')}, evidence FROM all_moves", "all_moves")
QUERIES["aligned_shares"] = aligned_shares
ORACLES["aligned_shares"] = sql(
    """SELECT r.code, r.date, round(coalesce(m.v, r.held), 6) AS outstanding_shares, CAST(m.v IS NOT NULL AS INT) AS moved FROM share_rows r LEFT JOIN (
SELECT code, i, arg_max(v, seq) AS v FROM (SELECT code, seq, CASE WHEN source < effective THEN old ELSE new END AS v, unnest(range(least(source, effective), greatest(source, effective))) AS i FROM all_moves) GROUP BY code, i) m ON m.code = r.code AND m.i = r.i""",
    "all_moves",
)


# Every third instrument is complete but for single rows; the next lacks its first rows, has no early actions and another scale later; the last lacks rows all over and has two scales.
GONE = "CASE WHEN CAST(code AS INT) % 3 = 1 THEN i < 6 ELSE h % 9 = 4 END"


def reconstructed_close(spark, d):
    from tapeloom.functions import windows as w

    acts = _actions(spark, d).filter("CAST(code AS INT) % 3 <> 1 OR date >= DATE'1994-06-01'")
    adjusted = q.backward_adjust(bars(spark, d), acts).selectExpr("code", "date", "close AS adj")
    b = bars(spark, d).selectExpr("code", "date", "close", f"{H} AS h", f"{w.ROW_INDEX} - 1 AS i").join(adjusted, ["code", "date"])
    current = b.filter(f"NOT ({GONE})").selectExpr(
        "code", "date", "adj * 1.3D * CASE WHEN CAST(code AS INT) % 3 <> 0 AND i > 60 THEN 1.1D WHEN h % 50 = 1 THEN 1.001D ELSE 1 END AS close", "close AS close_raw"
    )
    missing = b.filter(GONE).selectExpr("code", "date", "close AS open_raw", "close AS high_raw", "CASE WHEN CAST(code AS INT) % 15 = 3 AND h % 2 = 0 THEN CAST(NULL AS DOUBLE) ELSE close END AS low_raw", "close AS close_raw")
    got = cal.reconstruct_missing_close(current, missing, acts, least=20)
    return out(got.selectExpr("code", "date", "ln(close) AS log_close", "method", "scale", "reason"), "*")


cte(
    "rebuilt_all",
    f"""SELECT b.code, b.date, b.close, b.h, b.i, ln(b.close) + sum(coalesce(f.lf, 0)) OVER (PARTITION BY b.code ORDER BY b.date) AS la, {GONE.replace('code', 'b.code').replace('i <', 'b.i <').replace('h %', 'b.h %')} AS gone FROM (SELECT *, {HS} AS h, row_number() OVER {S} - 1 AS i FROM bars) b LEFT JOIN (
SELECT code, bar, sum(ln(CASE WHEN pc > 0 AND pc - cash_per_share + rights_ratio*rights_price > 0 THEN pc*(1 + bonus_ratio + rights_ratio)/(pc - cash_per_share + rights_ratio*rights_price) ELSE 1 + bonus_ratio + rights_ratio END)) AS lf
FROM (SELECT a.*, x.date AS bar, x.pc FROM (SELECT * FROM ({ACT.format(h=HS)}) WHERE CAST(code AS INT) % 3 <> 1 OR date >= DATE '1994-06-01') a ASOF JOIN (SELECT code, date, lag(close) OVER {S} AS pc FROM bars) x ON x.code = a.code AND x.date >= a.date) GROUP BY code, bar) f ON f.code = b.code AND f.bar = b.date""",
    "bars",
)
# The adjustment factor depends on all rows; raw closes of present and missing rows are the same rows.
cte(
    "scales",
    f"""SELECT *, CASE WHEN rows < 20 THEN 'insufficient_committed_overlap' WHEN NOT priced THEN 'missing_raw_price' END AS why FROM (
SELECT a.code, count(*) FILTER (NOT gone) AS rows, min(a.date) FILTER (NOT gone) AS start, max(a.date) FILTER (gone) AS last_gone, bool_and(NOT (CAST(a.code AS INT) % 15 = 3 AND h % 2 = 0)) FILTER (gone) AS priced, any_value(full_scale) AS full_scale,
  quantile_cont(abs(ratio/full_scale - 1), 0.99) AS p99, max(abs(ratio/full_scale - 1)) AS most, median(ratio) FILTER (k <= 20) AS lead FROM (
SELECT *, CASE WHEN NOT gone THEN row_number() OVER (PARTITION BY code, gone ORDER BY date) END AS k, median(ratio) OVER (PARTITION BY code) AS full_scale FROM (
SELECT *, CASE WHEN NOT gone THEN 1.3 * CASE WHEN CAST(code AS INT) % 3 <> 0 AND i > 60 THEN 1.1 WHEN h % 50 = 1 THEN 1.001 ELSE 1 END END::DOUBLE AS ratio FROM rebuilt_all)) a GROUP BY a.code)""",
    "rebuilt_all",
)
QUERIES["reconstructed_close"] = reconstructed_close
ORACLES["reconstructed_close"] = sql(
    f"""SELECT code, date, round(CASE WHEN method IS NOT NULL THEN la + ln(scale) END, 6) + 0.0 AS log_close, method, CASE WHEN method IS NOT NULL THEN round(scale, 6) + 0.0 END AS scale, CASE WHEN method IS NULL THEN coalesce(why, 'adjustment_scale_not_proven') END AS reason FROM (
SELECT r.code, r.date, r.la, s.why, CASE WHEN why IS NOT NULL THEN NULL WHEN p99 <= 0.002 AND most <= 0.02 THEN 'full_overlap_stable_scale' WHEN last_gone < start AND coalesce(early, 0) = 0 AND spread <= 0.002 THEN 'clean_pre_action_prefix' END AS method,
  CASE WHEN p99 <= 0.002 AND most <= 0.02 THEN full_scale ELSE lead END AS scale FROM rebuilt_all r JOIN scales s USING (code)
LEFT JOIN (SELECT x.code, max(abs(ratio/lead - 1)) AS spread FROM (SELECT code, 1.3 * CASE WHEN CAST(code AS INT) % 3 <> 0 AND i > 60 THEN 1.1 WHEN h % 50 = 1 THEN 1.001 ELSE 1 END::DOUBLE AS ratio FROM rebuilt_all WHERE NOT gone QUALIFY row_number() OVER (PARTITION BY code ORDER BY date) <= 20) x JOIN scales y ON y.code = x.code GROUP BY x.code) h ON h.code = r.code
LEFT JOIN (SELECT a.code, count(*) AS early FROM ({ACT.format(h=HS)}) a JOIN scales s ON s.code = a.code WHERE (CAST(a.code AS INT) % 3 <> 1 OR a.date >= DATE '1994-06-01') AND a.date <= s.start GROUP BY a.code) e ON e.code = r.code WHERE gone)""",
    "scales",
)
