"""Data quality and repair (Q*, A22, J10, J11, J16, J17, J20, P12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import windows as w
from tapeloom.operators import quality as q
from tapeloom.suite.common import bars, out
from tapeloom.suite.sqlbase import ALL, CTES, S, cte, i, r, sql
from tapeloom.suite.sqlbase import w as sw

QUERIES, ORACLES = {}, {}

# A second source is the first with rows dropped, scaled or blanked by arithmetic on (code, week).
H = "(CAST(datediff(date, DATE'1990-01-01') / 7 AS INT) + CAST(code AS INT) * 3)"
HS = "(CAST(floor((date - DATE '1990-01-01')/7) AS INT) + CAST(code AS INT)*3)"


def clean(spark, d):
    return q.derive_change_fields(bars(spark, d))


def dirty(spark, d):
    b = clean(spark, d).selectExpr("*", f"{H} AS h").filter("h % 17 <> 0")
    return b.selectExpr(
        "code",
        "date",
        "open",
        "CASE WHEN h % 31 = 4 THEN greatest(open, close) * 0.995D ELSE high END AS high",
        "low",
        "CASE WHEN h % 23 = 1 THEN close * 1.1D ELSE close END AS close",
        "close_raw",
        "CASE WHEN h % 29 = 3 THEN volume * 100 ELSE volume END AS volume",
        "CASE WHEN h % 19 <> 2 THEN amount END AS amount",
        "turnover",
        "market_cap",
        "CASE WHEN h % 13 = 5 THEN change_pct + 1 ELSE change_pct END AS change_pct",
        "amplitude",
    )


cte("clean", f"SELECT *, close - pc AS change, (close/pc - 1)*100 AS change_pct, (high - low)/pc*100 AS amplitude FROM (SELECT *, lag(close) OVER {S} AS pc FROM bars)", "bars")
cte(
    "dirty",
    f"""SELECT code, date, open, CASE WHEN h % 31 = 4 THEN greatest(open, close)*0.995 ELSE high END AS high, low, CASE WHEN h % 23 = 1 THEN close*1.1 ELSE close END AS close, close_raw,
 CASE WHEN h % 29 = 3 THEN volume*100 ELSE volume END AS volume, CASE WHEN h % 19 <> 2 THEN amount END AS amount, turnover, market_cap, CASE WHEN h % 13 = 5 THEN change_pct + 1 ELSE change_pct END AS change_pct, amplitude
FROM (SELECT *, {HS} AS h FROM clean) WHERE h % 17 <> 0""",
    "clean",
)
cte(
    "audit",
    f"""SELECT *, return_eligible AND abs(cc - change_pct) > 0.25 AS return_bad, amplitude_eligible AND abs(ca - amplitude) > 0.25 AS amplitude_bad, abs(cc - change_pct) AS return_error, abs(ca - amplitude) AS amplitude_error FROM (
SELECT *, cc IS NOT NULL AND change_pct IS NOT NULL AS return_eligible, ca IS NOT NULL AND amplitude IS NOT NULL AS amplitude_eligible FROM (SELECT *, (close/lag(close) OVER {S} - 1)*100 AS cc, (high - low)/lag(close) OVER {S}*100 AS ca FROM dirty))""",
    "dirty",
)


def audit_bars(spark, d):
    return out(q.audit_bars(dirty(spark, d)), "code date return_eligible amplitude_eligible return_error amplitude_error return_bad amplitude_bad")


QUERIES["audit_bars"] = audit_bars
ORACLES["audit_bars"] = sql(f"SELECT code, date, {i('return_eligible amplitude_eligible return_bad amplitude_bad')}, {r('return_error amplitude_error')} FROM audit", "audit")


def cross_section_spike(spark, d):
    return out(q.cross_section_spike(q.audit_bars(dirty(spark, d)), 0.2, 5), "*")


QUERIES["cross_section_spike"] = cross_section_spike
ORACLES["cross_section_spike"] = sql(
    f"""SELECT date, return_eligible, return_bad, amplitude_eligible, amplitude_bad, {r('return_bad_ratio amplitude_bad_ratio')}, CAST(return_eligible >= 5 AND return_bad_ratio >= 0.2 AS INT) AS return_spike, CAST(amplitude_eligible >= 5 AND amplitude_bad_ratio >= 0.2 AS INT) AS amplitude_spike,
 CAST((return_eligible >= 5 AND return_bad_ratio >= 0.2) OR (amplitude_eligible >= 5 AND amplitude_bad_ratio >= 0.2) AS INT) AS quarantine FROM (SELECT *, coalesce(return_bad/nullif(return_eligible, 0), 0) AS return_bad_ratio, coalesce(amplitude_bad/nullif(amplitude_eligible, 0), 0) AS amplitude_bad_ratio FROM (
SELECT date, count(*) FILTER (return_eligible) AS return_eligible, count(*) FILTER (return_bad) AS return_bad, count(*) FILTER (amplitude_eligible) AS amplitude_eligible, count(*) FILTER (amplitude_bad) AS amplitude_bad FROM audit GROUP BY date))""",
    "audit",
)


def issue_rows(spark, d):
    return out(q.issue_rows(q.audit_bars(dirty(spark, d))), "*")


QUERIES["issue_rows"] = issue_rows
ORACLES["issue_rows"] = sql(
    f"""SELECT code, date, kind, {r('stored computed error')} FROM (SELECT code, date, 'return' AS kind, change_pct AS stored, cc AS computed, return_error AS error FROM audit WHERE return_bad UNION ALL SELECT code, date, 'amplitude', amplitude, ca, amplitude_error FROM audit WHERE amplitude_bad)""",
    "audit",
)
FIELDS = ("close", "volume", "amount", "turnover", "change_pct")


def field_quality(spark, d):
    return out(q.field_quality(dirty(spark, d), FIELDS), "*")


QUERIES["field_quality"] = field_quality
ORACLES["field_quality"] = sql(
    " UNION ALL ".join(
        f"SELECT '{f}' AS field, count({f}) AS finite, count(*) FILTER ({f} > 0) AS valid, count(*) FILTER ({f} IS NULL AND volume > 0) AS missing_traded, count(*) FILTER ({f} IS NULL AND NOT volume > 0) AS missing_suspended, count(*) FILTER ({f} = 0) AS zero, count(*) FILTER ({f} < 0) AS negative FROM dirty"
        for f in FIELDS
    ),
    "dirty",
)


def completed_bars(spark, d):
    return out(q.completed_bars(dirty(spark, d)), "code date close volume")


QUERIES["completed_bars"] = completed_bars
ORACLES["completed_bars"] = sql(
    f"SELECT code, date, {r('close volume')} FROM dirty WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume > 0 AND amount > 0 AND high >= greatest(open, close) AND low <= least(open, close)", "dirty"
)


def compare_sources(spark, d):
    return out(q.compare_sources(dirty(spark, d), bars(spark, d)), "*")


QUERIES["compare_sources"] = compare_sources
ORACLES["compare_sources"] = sql(
    """SELECT CAST(year(date) AS INT) AS year, count(*) FILTER (b.code IS NULL) AS only_left, count(*) FILTER (a.code IS NULL AND b.volume > 0) AS only_right_traded, count(*) FILTER (a.code IS NULL AND NOT b.volume > 0) AS only_right_idle, count(*) FILTER (a.code IS NOT NULL AND b.code IS NOT NULL) AS shared,
 count(*) FILTER (abs(a.close/b.close - 1) <= 1e-6) AS equal_close, count(*) FILTER (a.amount > 0 AND b.amount > 0) AS both_amount, count(*) FILTER (a.code IS NOT NULL AND a.amount IS NULL AND b.amount > 0 AND a.volume > 0 AND abs(b.volume/a.volume - 1) <= 0.01) AS amount_candidates
FROM dirty a FULL JOIN bars b USING (code, date) GROUP BY 1""",
    "dirty",
)
cte("gaps", "SELECT code, date, 'bar' AS gap FROM bars b WHERE volume > 0 AND NOT EXISTS (SELECT 1 FROM dirty d WHERE d.code = b.code AND d.date = b.date) UNION ALL SELECT code, date, 'amount' FROM dirty WHERE volume > 0 AND amount IS NULL", "dirty")


def identify_gaps(spark, d):
    return q.identify_gaps(dirty(spark, d), bars(spark, d))


QUERIES["identify_gaps"] = identify_gaps
ORACLES["identify_gaps"] = sql("SELECT code, date, gap FROM gaps", "gaps")


def gap_top_dates(spark, d):
    return q.gap_top_dates(q.identify_gaps(dirty(spark, d), bars(spark, d)), 20)


QUERIES["gap_top_dates"] = gap_top_dates
ORACLES["gap_top_dates"] = sql("SELECT date, gap, count(*) AS codes FROM gaps GROUP BY date, gap ORDER BY codes DESC, date, gap LIMIT 20", "gaps")


def validate_raw_bar(spark, d):
    return out(q.validate_raw_bar(dirty(spark, d)), "code date reason")


QUERIES["validate_raw_bar"] = validate_raw_bar
ORACLES["validate_raw_bar"] = sql(
    """SELECT code, date, CASE WHEN NOT coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume > 0 AND amount > 0, false) THEN 'missing_field' WHEN low > high THEN 'low_above_high' WHEN least(open, close) < low*0.99 THEN 'body_below_low' WHEN greatest(open, close) > high*1.01 THEN 'body_above_high'
 WHEN NOT amount/volume BETWEEN low*0.99 AND high*1.01 THEN 'vwap_outside' WHEN NOT coalesce(turnover > 0 AND turnover <= 1000, false) THEN 'invalid_turnover' WHEN market_cap IS NOT NULL AND abs(market_cap/(close*volume*100/turnover) - 1) > 0.01 THEN 'cap_mismatch' END AS reason FROM dirty""",
    "dirty",
)


def validate_history(spark, d):
    rows = bars(spark, d).unionByName(dirty(spark, d).selectExpr("concat('D', code) AS code", "date", "open", "high", "low", "close", "close_raw", "volume", "amount", "turnover", "market_cap"))
    return out(q.validate_history(rows, 0.8, 0.9), "*")


QUERIES["validate_history"] = validate_history
ORACLES["validate_history"] = sql(
    f"""SELECT code, n AS rows, date_start, date_end, {r('amount_coverage cap_coverage')}, CASE WHEN n > nd THEN 'duplicate_dates' WHEN bp > 0 THEN 'invalid_price' WHEN bo > 0 THEN 'invalid_order' WHEN amount_coverage < 0.8 THEN 'amount_coverage' WHEN bt > 0 THEN 'trade_value_mismatch' WHEN cap_coverage < 0.9 THEN 'cap_coverage' WHEN fe > 1e-9 THEN 'cap_formula' END AS reason FROM (
SELECT code, count(*) AS n, count(DISTINCT date) AS nd, min(date) AS date_start, max(date) AS date_end, count(*) FILTER (NOT (open > 0 AND high > 0 AND low > 0 AND close > 0 AND close_raw > 0)) AS bp,
 count(*) FILTER (high + 1e-9 < greatest(open, close) OR low - 1e-9 > least(open, close) OR high + 1e-9 < low) AS bo, count(*) FILTER (amount > 0)/count(*) AS amount_coverage, count(*) FILTER (turnover > 0 AND market_cap IS NOT NULL)/count(*) AS cap_coverage,
 count(*) FILTER (amount > 0 AND NOT amount/volume/close_raw BETWEEN 0.5 AND 2 AND NOT (k <= 5 AND amount/volume/close_raw BETWEEN 0.2 AND 2)) AS bt, max(abs(market_cap/(close_raw*volume*100/turnover) - 1)) AS fe
FROM (SELECT *, row_number() OVER {S} AS k FROM (SELECT code, date, open, high, low, close, close_raw, volume, amount, turnover, market_cap FROM bars UNION ALL SELECT 'D' || code, date, open, high, low, close, close_raw, volume, amount, turnover, market_cap FROM dirty)) GROUP BY code)""",
    "dirty",
)


def derive_change_fields(spark, d):
    return out(clean(spark, d), "code date change change_pct amplitude")


QUERIES["derive_change_fields"] = derive_change_fields
ORACLES["derive_change_fields"] = sql(f"SELECT code, date, {r('change change_pct amplitude')} FROM clean", "clean")


def turnover_and_cap(spark, d):
    b = bars(spark, d).selectExpr("*", f"CASE WHEN {H} % 3 = 0 THEN 5000D END AS shares")
    return out(q.turnover_and_cap(b), "code date turnover market_cap")


QUERIES["turnover_and_cap"] = turnover_and_cap
ORACLES["turnover_and_cap"] = sql(
    f"SELECT code, date, round(CASE WHEN {HS} % 3 = 0 THEN volume*100/5000 ELSE turnover END, 6) AS turnover, round(close_raw*CASE WHEN {HS} % 3 = 0 THEN 5000 ELSE volume*100/turnover END, 6) AS market_cap FROM bars", "bars"
)


def repair_envelope(spark, d):
    return out(q.repair_envelope(dirty(spark, d)), "code date old_high high low repaired")


QUERIES["repair_envelope"] = repair_envelope
ORACLES["repair_envelope"] = sql(
    f"""SELECT code, date, {r('old_high')}, round(CASE WHEN ok THEN nh ELSE old_high END, 6) + 0.0 AS high, round(CASE WHEN ok THEN nl ELSE low END, 6) + 0.0 AS low, CAST(ok AS INT) AS repaired FROM (SELECT *, high AS old_high, greatest(nh - high, low - nl)/nh > 0 AND greatest(nh - high, low - nl)/nh <= 0.01 AS ok FROM (
SELECT *, greatest(open, high, low, close) AS nh, least(open, high, low, close) AS nl FROM dirty))""",
    "dirty",
)


def flat_bar_amount(spark, d):
    return out(q.flat_bar_amount(dirty(spark, d)), "code date amount filled")


QUERIES["flat_bar_amount"] = flat_bar_amount
ORACLES["flat_bar_amount"] = sql(
    f"SELECT code, date, round(CASE WHEN f THEN close_raw*volume ELSE amount END, 6) + 0.0 AS amount, CAST(f AS INT) AS filled FROM (SELECT *, open = high AND high = low AND low = close AND volume > 0 AND amount IS NULL AS f FROM dirty)", "dirty"
)


def fill_amount(spark, d):
    return out(q.fill_amount(dirty(spark, d), bars(spark, d)), "code date amount filled")


QUERIES["fill_amount"] = fill_amount
ORACLES["fill_amount"] = sql(
    f"""SELECT code, date, round(CASE WHEN ok THEN ba ELSE amount END, 6) + 0.0 AS amount, CAST(ok AS INT) AS filled FROM (SELECT a.*, b.amount AS ba, coalesce(a.amount IS NULL AND b.amount > 0 AND abs(b.volume/a.volume - 1) <= 0.01 AND b.amount/a.volume BETWEEN a.low*0.99 AND a.high*1.01, false) AS ok FROM dirty a LEFT JOIN bars b USING (code, date))""",
    "dirty",
)


def fill_valuation(spark, d):
    base = bars(spark, d).selectExpr("code", "date", "CASE WHEN day(date) % 2 = 0 THEN turnover ELSE 0D END AS pe")
    s1 = dirty(spark, d).selectExpr("code", "date", "CASE WHEN month(date) % 2 = 0 THEN close ELSE 4294967295D END AS pe")
    s2 = bars(spark, d).selectExpr("code", "date", "-volume AS pe")
    return out(q.fill_valuation(base, [s1, s2], "pe", "1999-12-31"), "*")


QUERIES["fill_valuation"] = fill_valuation
ORACLES["fill_valuation"] = sql(
    f"""SELECT b.code, b.date, round(CASE WHEN day(b.date) % 2 = 0 THEN b.turnover WHEN b.date <= DATE '1999-12-31' THEN coalesce(CASE WHEN month(b.date) % 2 = 0 THEN d.close END, -b.volume) END, 6) + 0.0 AS pe FROM bars b LEFT JOIN dirty d ON d.code = b.code AND d.date = b.date""",
    "dirty",
)


def stable_adjustment_factor(spark, d):
    return out(q.stable_adjustment_factor(dirty(spark, d), 5, 0.05), "code date before_factor after_factor factor reason")


QUERIES["stable_adjustment_factor"] = stable_adjustment_factor
ORACLES["stable_adjustment_factor"] = sql(
    f"""SELECT code, date, {r('before_factor after_factor factor')}, CASE WHEN before_factor IS NULL OR after_factor IS NULL THEN 'missing_anchor' WHEN abs(before_factor/after_factor - 1) > 0.05 THEN 'anchor_mismatch' END AS reason FROM (
SELECT *, CASE WHEN abs(before_factor/after_factor - 1) <= 0.05 THEN f END AS factor FROM (SELECT *, list_median(lb) AS before_factor, list_median(la) AS after_factor, list_median(list_concat(coalesce(lb, []), coalesce(la, []))) AS f FROM (
SELECT code, date, list(close/close_raw) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS lb, list(close/close_raw) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS la FROM dirty)))""",
    "dirty",
)


def insert_bars(spark, d):
    return out(q.insert_bars(dirty(spark, d), bars(spark, d)), "code date open high low close volume inserted")


QUERIES["insert_bars"] = insert_bars
ORACLES["insert_bars"] = sql(
    f"""SELECT code, date, {r('open high low close volume')}, CAST(inserted AS INT) AS inserted FROM (SELECT code, date, open, high, low, close, volume, false AS inserted FROM dirty
UNION ALL SELECT code, date, open*f, high*f, low*f, close*f, volume, true FROM (SELECT b.*, (SELECT arg_max(close/close_raw, date) FROM dirty d WHERE d.code = b.code AND d.date < b.date) AS f FROM bars b WHERE NOT EXISTS (SELECT 1 FROM dirty d WHERE d.code = b.code AND d.date = b.date)) WHERE f IS NOT NULL)""",
    "dirty",
)


def _remote(spark, d):
    return bars(spark, d).selectExpr("code", "date", *[f"{c} * 2 + 3 AS {c}" for c in ("open", "high", "low", "close")])


def affine_transform(spark, d):
    return out(q.affine_transform(dirty(spark, d), _remote(spark, d), max_error=0.5), "*")


cte(
    "pairs",
    """SELECT code, date, d.close AS y, b.close*2 + 3 AS x, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS k FROM dirty d JOIN bars b USING (code, date) QUALIFY k <= 60""",
    "dirty",
)
cte(
    "fit",
    f"""SELECT *, CASE WHEN anchor_points < 3 THEN 'insufficient_overlap' WHEN variation < 0.005 THEN 'insufficient_variation' WHEN NOT coalesce(slope > 0, false) THEN 'invalid_slope' WHEN max_error > 0.5 THEN 'unstable' ELSE 'stable' END AS status FROM (
SELECT p.code, count(*) AS anchor_points, any_value(f.s) AS slope, any_value(f.b) AS intercept, max(abs((f.s*x + f.b)/y - 1)) AS max_error, quantile_cont(abs((f.s*x + f.b)/y - 1), 0.95) AS p95_error, (max(x) - min(x))/greatest(abs(median(x)), 1e-12) AS variation
FROM pairs p JOIN (SELECT code, regr_slope(y, x) AS s, regr_intercept(y, x) AS b FROM (SELECT *, quantile_cont(e, 0.9) OVER (PARTITION BY code) AS c90, count(*) OVER (PARTITION BY code) AS n FROM (
  SELECT p.*, abs((s*x + b)/y - 1) AS e FROM pairs p JOIN (SELECT code, regr_slope(y, x) AS s, regr_intercept(y, x) AS b FROM pairs GROUP BY code) USING (code))) WHERE n < 10 OR round(e, 12) <= round(c90, 12) GROUP BY code) f USING (code) GROUP BY p.code)""",
    "pairs",
)
QUERIES["affine_transform"] = affine_transform
ORACLES["affine_transform"] = sql(f"SELECT code, anchor_points, {r('slope intercept max_error p95_error variation')}, status FROM fit", "fit")


def rebuild_segment(spark, d):
    local, remote = dirty(spark, d), _remote(spark, d)
    return out(q.rebuild_segment(local, remote, q.affine_transform(local, remote, max_error=0.5), "1998-01-01", "1999-12-31"), "code date close change_pct amplitude rebuilt")


QUERIES["rebuild_segment"] = rebuild_segment
ORACLES["rebuild_segment"] = sql(
    f"""SELECT code, date, {r('close change_pct amplitude')}, CAST(rebuilt AS INT) AS rebuilt FROM (SELECT code, date, close, (close/lag(close) OVER {S} - 1)*100 AS change_pct, (high - low)/lag(close) OVER {S}*100 AS amplitude, rebuilt FROM (
SELECT d.code, d.date, coalesce(f.slope*(b.close*2 + 3) + f.intercept, d.close) AS close, coalesce(f.slope*(b.high*2 + 3) + f.intercept, d.high) AS high, coalesce(f.slope*(b.low*2 + 3) + f.intercept, d.low) AS low, coalesce(abs((f.slope*(b.close*2 + 3) + f.intercept)/d.close - 1) > 1e-9, false) AS rebuilt
FROM dirty d LEFT JOIN bars b ON b.code = d.code AND b.date = d.date AND b.date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' LEFT JOIN fit f ON f.code = b.code AND f.status = 'stable'))""",
    "fit",
)


def rebase_scale(spark, d):
    return out(q.rebase_scale(dirty(spark, d), bars(spark, d)), "*")


QUERIES["rebase_scale"] = rebase_scale
ORACLES["rebase_scale"] = sql(
    f"""SELECT code, kind, anchors, {r('scale dispersion')}, CAST(dispersion <= 0.01 AS INT) AS accepted FROM (SELECT code, kind, count(*) AS anchors, median(ratio) AS scale, (quantile_cont(ratio, 0.9) - quantile_cont(ratio, 0.1))/median(ratio) AS dispersion FROM (
SELECT d.code, 'adjusted' AS kind, d.close/b.close AS ratio FROM dirty d JOIN bars b USING (code, date) UNION ALL SELECT d.code, 'raw', d.close_raw/b.close FROM dirty d JOIN bars b USING (code, date)) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY code ORDER BY round(dispersion, 12), kind) = 1""",
    "dirty",
)


def scale_sandwich(spark, d):
    return out(q.scale_sandwich(bars(spark, d), 0.3, 0.1), "code date scale_in sandwiched")


QUERIES["scale_sandwich"] = scale_sandwich
ORACLES["scale_sandwich"] = sql(
    f"SELECT code, date, round(close/p, 6) AS scale_in, CAST(coalesce(abs(n/p - 1) <= 0.1 AND abs(close/p - 1) > 0.3 AND abs(close/n - 1) > 0.3, false) AS INT) AS sandwiched FROM (SELECT *, lag(close) OVER {S} AS p, lead(close) OVER {S} AS n FROM bars)", "bars"
)


def provenance(spark, d):
    b = bars(spark, d)
    snaps = b.withColumn("source", F.lit("first")).unionByName(b.filter(f"{H} % 2 = 0").withColumn("source", F.lit("second")))
    return q.provenance(dirty(spark, d), snaps)


QUERIES["provenance"] = provenance
ORACLES["provenance"] = sql(
    f"""SELECT code, date, coalesce(string_agg(source, ',' ORDER BY source) FILTER (f), '') AS matched_sources, CASE WHEN count(*) FILTER (f) > 1 THEN 'multiple_full' WHEN count(*) FILTER (f) = 1 THEN 'unique_full' WHEN bool_or(c) THEN 'close_only' ELSE 'none' END AS provenance FROM (
SELECT d.code, d.date, s.source, abs(d.open - s.open) <= 1e-6*d.open AND abs(d.high - s.high) <= 1e-6*d.high AND abs(d.low - s.low) <= 1e-6*d.low AND abs(d.close - s.close) <= 1e-6*d.close AS f, coalesce(abs(d.close - s.close) <= 1e-6*d.close, false) AS c
FROM dirty d LEFT JOIN (SELECT *, 'first' AS source FROM bars UNION ALL SELECT *, 'second' FROM bars WHERE {HS} % 2 = 0) s USING (code, date)) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY code, date"),
    "dirty",
)


def apply_corrections(spark, d):
    c = bars(spark, d).filter(f"{H} % 23 IN (1, 2, 3)").selectExpr(
        "code", "date", f"CASE WHEN {H} % 23 = 3 THEN close + 1 WHEN {H} % 23 = 1 THEN close * 1.1D ELSE close END AS expected", "close AS corrected",
        f"CASE WHEN {H} % 23 = 2 THEN 'delete' ELSE 'replace' END AS action")
    return out(q.apply_corrections(dirty(spark, d), c), "code date close result")


QUERIES["apply_corrections"] = apply_corrections
ORACLES["apply_corrections"] = sql(
    f"""SELECT code, date, round(CASE WHEN h % 23 = 1 THEN bc ELSE close END, 6) + 0.0 AS close, CASE h % 23 WHEN 1 THEN 'replace' WHEN 3 THEN 'conflict' ELSE 'untouched' END AS result FROM (SELECT d.*, b.close AS bc, {HS.replace('date -', 'd.date -').replace('code AS', 'd.code AS')} AS h FROM dirty d JOIN bars b USING (code, date)) WHERE h % 23 <> 2""",
    "dirty",
)


def recompute_neighbours(spark, d):
    b = dirty(spark, d).selectExpr("*", f"{H} % 23 = 1 AS changed", "0D AS change")
    return out(q.recompute_neighbours(b), "code date touched change change_pct amplitude")


QUERIES["recompute_neighbours"] = recompute_neighbours
ORACLES["recompute_neighbours"] = sql(
    f"""SELECT code, date, CAST(t AS INT) AS touched, round(CASE WHEN t THEN close - p ELSE 0 END, 6) + 0.0 AS change, round(CASE WHEN t THEN (close/p - 1)*100 ELSE change_pct END, 6) + 0.0 AS change_pct, round(CASE WHEN t THEN (high - low)/p*100 ELSE amplitude END, 6) + 0.0 AS amplitude FROM (
SELECT *, coalesce(c OR lag(c) OVER {S}, false) AS t, lag(close) OVER {S} AS p FROM (SELECT *, {HS} % 23 = 1 AS c FROM dirty))""",
    "dirty",
)


def _quotes(spark, d):
    return bars(spark, d).groupBy("code").agg(F.expr("max_by(open, date)").alias("open"), F.expr("max_by(close, date) * CASE WHEN CAST(code AS INT) % 4 = 0 THEN 10 ELSE 1 END").alias("last_close"))


def adjusted_quotes(spark, d):
    return out(q.adjust_quotes(_quotes(spark, d), bars(spark, d)), "code factor adjusted_open out_of_range")


QUERIES["adjusted_quotes"] = adjusted_quotes
ORACLES["adjusted_quotes"] = sql(
    f"SELECT code, {r('factor adjusted_open')}, CAST(NOT factor BETWEEN 0.2 AND 5 AS INT) AS out_of_range FROM (SELECT code, 1.0/CASE WHEN CAST(code AS INT) % 4 = 0 THEN 10 ELSE 1 END AS factor, arg_max(open, date)/CASE WHEN CAST(code AS INT) % 4 = 0 THEN 10 ELSE 1 END AS adjusted_open FROM bars GROUP BY code)", "bars"
)


def open_quote_gate(spark, d):
    return out(q.open_quote_gate(_quotes(spark, d)), "*")


QUERIES["open_quote_gate"] = open_quote_gate
ORACLES["open_quote_gate"] = sql(
    f"SELECT {r('valid_share moved_share')}, CAST(valid_share >= 0.8 AND moved_share >= 0.3 AS INT) AS passed FROM (SELECT avg(CASE WHEN o > 0 THEN 1.0 ELSE 0 END) AS valid_share, avg(CASE WHEN abs(o/l - 1) > 1e-9 THEN 1.0 ELSE 0 END) AS moved_share FROM (SELECT arg_max(open, date) AS o, arg_max(close, date)*CASE WHEN CAST(code AS INT) % 4 = 0 THEN 10 ELSE 1 END AS l FROM bars GROUP BY code))", "bars"
)


def bar_availability(spark, d):
    b = bars(spark, d)
    return q.bar_availability(b.select("code", "date"), dirty(spark, d), b.filter(f"{H} % 34 IN (0, 1)"), b.filter(f"{H} % 51 = 17"))


QUERIES["bar_availability"] = bar_availability
ORACLES["bar_availability"] = sql(
    f"""SELECT code, date, CASE WHEN p AND c THEN 'conflict' WHEN p THEN 'present' WHEN c THEN 'confirmed_absent' WHEN f THEN 'failed' ELSE 'unknown' END AS availability FROM (SELECT code, date, {HS} % 17 <> 0 AS p, {HS} % 34 IN (0, 1) AS c, {HS} % 51 = 17 AS f FROM bars)""",
    "bars",
)


def nearby_duplicates(spark, d):
    return q.nearby_duplicates(bars(spark, d), 7, 0.05)


QUERIES["nearby_duplicates"] = nearby_duplicates
ORACLES["nearby_duplicates"] = sql(
    "SELECT a.code, a.date, b.date AS other_date FROM bars a JOIN bars b ON b.code = a.code AND b.date <> a.date AND abs(b.date - a.date) <= 7 AND abs(b.close/a.close - 1) <= 0.05 AND abs(b.volume/a.volume - 1) <= 0.05", "bars"
)


def match_events(spark, d):
    b = bars(spark, d).selectExpr("code", f"{w.ROW_INDEX} AS rn", f"volume / {w.ref('volume')} AS ratio", f"close / {w.ref('close')} AS pr")
    return out(q.match_events(b.filter("ratio > 2").select("code", "rn", "ratio"), b.filter("pr > 1.2").selectExpr("code", "rn", "pr * 1.5 AS ratio")), "*")


QUERIES["match_events"] = match_events
ORACLES["match_events"] = sql(
    f"""WITH b2 AS (SELECT code, row_number() OVER {S} AS rn, volume/lag(volume) OVER {S} AS ratio, close/lag(close) OVER {S} AS pr FROM bars)
SELECT code, CAST(rn AS INT) AS rn, CAST(ern AS INT) AS event_rn, round(err, 6) + 0.0 AS error, CAST(abs(ern - rn) AS INT) AS distance FROM (SELECT a.code, a.rn, e.rn AS ern, abs(a.ratio/(e.pr*1.5) - 1) AS err FROM b2 a JOIN b2 e ON e.code = a.code AND abs(e.rn - a.rn) <= 5 AND e.pr > 1.2 WHERE a.ratio > 2) WHERE err <= 0.03
QUALIFY row_number() OVER (PARTITION BY code, rn ORDER BY round(err, 12), abs(ern - rn), ern) = 1""",
    "bars",
).replace("\nWITH b2 AS (", ",\nb2 AS (", 1)

ACT = "SELECT code, date + 3 AS date, 0.1*(h % 5) AS bonus_ratio, 0.01*(h % 7)*close AS cash_per_share, CASE WHEN h % 2 = 0 THEN 0.2 ELSE 0.0 END AS rights_ratio, close*0.5 AS rights_price FROM (SELECT *, {h} AS h FROM bars) WHERE h % 11 = 0"


def _actions(spark, d):
    return bars(spark, d).selectExpr("*", f"{H} AS h").filter("h % 11 = 0").selectExpr(
        "code", "date_add(date, 3) AS date", "0.1D * (h % 5) AS bonus_ratio", "0.01D * (h % 7) * close AS cash_per_share",
        "CASE WHEN h % 2 = 0 THEN 0.2D ELSE 0D END AS rights_ratio", "close * 0.5D AS rights_price")


def backward_adjust(spark, d):
    return out(q.backward_adjust(bars(spark, d), _actions(spark, d)).selectExpr("code", "date", "ln(adjust_factor) AS log_factor", "ln(close) AS log_close"), "*")


QUERIES["backward_adjust"] = backward_adjust
ORACLES["backward_adjust"] = sql(
    f"""SELECT code, date, round(lf, 6) + 0.0 AS log_factor, round(ln(close) + lf, 6) + 0.0 AS log_close FROM (SELECT b.code, b.date, b.close, sum(coalesce(f.lf, 0)) OVER (PARTITION BY b.code ORDER BY b.date) AS lf FROM bars b LEFT JOIN (
SELECT code, bar, sum(ln(CASE WHEN pc > 0 AND pc - cash_per_share + rights_ratio*rights_price > 0 THEN pc*(1 + bonus_ratio + rights_ratio)/(pc - cash_per_share + rights_ratio*rights_price) ELSE 1 + bonus_ratio + rights_ratio END)) AS lf
FROM (SELECT a.*, x.date AS bar, x.pc FROM ({ACT.format(h=HS)}) a ASOF JOIN (SELECT code, date, lag(close) OVER {S} AS pc FROM bars) x ON x.code = a.code AND x.date >= a.date) GROUP BY code, bar) f ON f.code = b.code AND f.bar = b.date)""",
    "bars",
)


def action_chain_affine(spark, d):
    a = _actions(spark, d).selectExpr("code", "date", "1 + bonus_ratio / 10 AS multiplier", "cash_per_share / 100 AS additive")
    return out(q.action_chain_affine(a).selectExpr("code", "date", "ln(slope) AS log_slope", "intercept"), "*")


QUERIES["action_chain_affine"] = action_chain_affine
ORACLES["action_chain_affine"] = sql(
    f"""SELECT code, date, round(ln(slope), 6) + 0.0 AS log_slope, round(sum(prev*additive) OVER {ALL}, 6) + 0.0 AS intercept FROM (SELECT *, coalesce(lag(slope) OVER {S}, 1) AS prev FROM (SELECT code, date, product(1 + bonus_ratio/10) OVER {ALL} AS slope, cash_per_share/100 AS additive FROM ({ACT.format(h=HS)})))""",
    "bars",
)


# Volumes of two spans of each instrument are given in wrong units, and some rows alone; some amounts are missing, sentinels, or not positive.
UNITS = (
    "volume * CASE WHEN year(date) = 1997 THEN 100 WHEN year(date) = 1999 AND month(date) < 7 THEN 0.1{D} WHEN h % 37 = 9 THEN 10 ELSE 1 END",
    "CASE WHEN h % 31 = 7 THEN 2147483647{D} WHEN h % 29 = 5 THEN NULL WHEN h % 43 = 2 THEN 0{D} ELSE amount END",
)


def _units(spark, d):
    volume, amount = (x.format(D="D") for x in UNITS)
    return bars(spark, d).selectExpr("*", f"{H} AS h").selectExpr("code", "date", "low", "high", "close", "close_raw", f"{volume} AS volume", f"{amount} AS amount", "turnover", "market_cap", "h", "amount AS true_amount")


def repair_trade_units(spark, d):
    b = _units(spark, d).selectExpr("code", "date", "low AS low_raw", "high AS high_raw", "close_raw", "volume", "amount")
    return out(q.repair_trade_units(b, candidates=(100.0, 10.0), least=10), "code date volume amount unit_repair")


def repair_committed_units(spark, d):
    """Prices adjusted by a factor of the instrument; references for every fifth row, some of them wrong."""
    b = _units(spark, d)
    f = "(1 + 0.25D * (CAST(code AS INT) % 3))"
    committed = b.selectExpr("code", "date", f"low * {f} AS low", f"high * {f} AS high", f"close * {f} AS close", "close_raw", "volume", "amount", "turnover", "CASE WHEN h % 6 <> 0 THEN market_cap END AS market_cap")
    reference = b.filter("h % 5 = 0").selectExpr("code", "date", "CASE WHEN h % 50 = 10 THEN true_amount * 3 WHEN h % 35 = 0 THEN -1D ELSE true_amount * 1.001D END AS amount")
    return out(q.repair_committed_units(committed, reference, (100.0, 10.0), 10), "code date volume amount turnover market_cap repair")


MULTIPLIERS = (100.0, 10.0, 0.01, 0.1)


def _regimes_sql(name: str, source: str) -> None:
    """CTEs that take regimes multiplier by multiplier, most explained rows first, from rows (code, date, lo, hi, volume, amount)."""
    bad = "coalesce({v} > 0 AND amount > 0 AND lo > 0 AND hi >= lo AND NOT amount/{v} BETWEEN lo*0.98 AND hi*1.02, false)"
    flags = ", ".join(f"({bad.format(v='volume')} AND amount/volume/{m} BETWEEN lo*0.98 AND hi*1.02) AS c{k}" for k, m in enumerate(MULTIPLIERS))
    cte(
        f"{name}0",
        f"SELECT *, row_number() OVER {S} AS rn, volume AS vol, false AS taken, {bad.format(v='volume')} AS bad, coalesce(volume > 0 AND amount > 0 AND lo > 0 AND hi >= lo, false) AS known, {flags} FROM ({source})",
        "bars",
    )
    counts = " UNION ALL ".join(f"SELECT code, {k} AS k, count_if(c{k}) AS n FROM {name}0 GROUP BY code" for k in range(len(MULTIPLIERS)))
    cte(f"{name}order", f"SELECT code, k, row_number() OVER (PARTITION BY code ORDER BY n DESC, k) - 1 AS p FROM ({counts})", f"{name}0")
    pick = "CASE k " + " ".join(f"WHEN {k} THEN c{k}" for k in range(len(MULTIPLIERS))) + " END"
    scale = "CASE k " + " ".join(f"WHEN {k} THEN {m}" for k, m in enumerate(MULTIPLIERS)) + " END"
    for p in range(len(MULTIPLIERS)):
        cte(
            f"{name}{p + 1}",
            f"""SELECT * EXCLUDE (k, p, mine, ev, seg, n, a, z, every, m, take) REPLACE (taken OR take AS taken, CASE WHEN take THEN vol*{scale} ELSE vol END AS vol) FROM (
SELECT *, coalesce(rn BETWEEN a AND z AND NOT taken AND volume > 0 AND every >= 10 AND n >= 10 AND m > 0 AND n/m >= 0.8, false) AS take FROM (
SELECT *, count_if(bad AND rn BETWEEN a AND z AND NOT taken) OVER (PARTITION BY code, seg) AS m FROM (
SELECT *, count_if(ev) OVER (PARTITION BY code, seg) AS n, min(CASE WHEN ev THEN rn END) OVER (PARTITION BY code, seg) AS a, max(CASE WHEN ev THEN rn END) OVER (PARTITION BY code, seg) AS z, count_if(ev) OVER (PARTITION BY code) AS every FROM (
SELECT *, mine AND NOT taken AS ev, count_if(taken OR (known AND NOT bad) OR (bad AND NOT mine)) OVER (PARTITION BY code ORDER BY rn) AS seg FROM (SELECT *, {pick} AS mine FROM {name}{p} JOIN {name}order USING (code) WHERE p = {p})))))""",
            f"{name}{p}",
            f"{name}order",
        )
    cte(
        f"{name}fixed",
        f"""SELECT code, date, fin AS volume, CASE WHEN NOT {bad.format(v='fin')} THEN amount END AS amount, CASE WHEN taken THEN 'regime' WHEN iso IS NOT NULL THEN 'isolated' ELSE 'none' END AS unit_repair FROM (SELECT *, vol*coalesce(iso, 1) AS fin FROM (
SELECT *, CASE WHEN {bad.format(v='vol')} THEN CASE WHEN amount/vol/10 BETWEEN lo AND hi AND NOT amount/vol/0.1 BETWEEN lo AND hi THEN 10 WHEN amount/vol/0.1 BETWEEN lo AND hi AND NOT amount/vol/10 BETWEEN lo AND hi THEN 0.1 END END AS iso FROM {name}{len(MULTIPLIERS)}))""",
        f"{name}{len(MULTIPLIERS)}",
    )


_VOLUME, _AMOUNT = (x.format(D=".0::DOUBLE" if "2147483647" in x else "::DOUBLE") for x in UNITS)
cte("units", f"SELECT code, date, low, high, close, close_raw, {_VOLUME} AS volume, {_AMOUNT} AS amount, turnover, market_cap, h, amount AS true_amount FROM (SELECT *, {HS} AS h FROM bars)", "bars")
_VALID = "CASE WHEN {a} <> 2147483647 AND NOT (volume > 0 AND {a} <= 0) THEN {a} END"
_regimes_sql("u", f"SELECT code, date, low AS lo, high AS hi, volume, {_VALID.format(a='amount')} AS amount FROM units")
_regimes_sql(
    "v",
    f"""SELECT code, date, (low*f)/((close*f)/close_raw) AS lo, (high*f)/((close*f)/close_raw) AS hi, volume, {_VALID.format(a='amt')} AS amount FROM (
SELECT *, 1 + 0.25::DOUBLE*(CAST(code AS INT) % 3) AS f, CASE WHEN h % 5 = 0 AND (h % 50 = 10 OR h % 35 <> 0) THEN true_amount*CASE WHEN h % 50 = 10 THEN 3 ELSE 1.001::DOUBLE END ELSE amount END AS amt FROM units)""",
)
for _name in ("u0", "v0"):
    CTES[_name] = (("units",), CTES[_name][1])

QUERIES["repair_trade_units"] = repair_trade_units
ORACLES["repair_trade_units"] = sql(f"SELECT code, date, {r('volume amount')}, unit_repair FROM ufixed", "ufixed")
QUERIES["repair_committed_units"] = repair_committed_units
ORACLES["repair_committed_units"] = sql(
    f"""SELECT code, date, round(CASE WHEN changed THEN nv ELSE volume END, 6) + 0.0 AS volume, round(CASE WHEN cleared THEN NULL WHEN filled OR swapped THEN na ELSE amount END, 6) + 0.0 AS amount,
 round(CASE WHEN again THEN nv*100/shares ELSE turnover END, 6) + 0.0 AS turnover, round(CASE WHEN again AND cap IS NULL THEN close_raw*shares ELSE cap END, 6) + 0.0 AS market_cap,
 array_to_string(list_filter([CASE WHEN changed THEN 'volume' END, CASE WHEN cleared THEN 'amount_cleared' END, CASE WHEN filled THEN 'amount_filled' END, CASE WHEN swapped THEN 'amount_replaced' END, CASE WHEN again THEN 'turnover' END, CASE WHEN again AND cap IS NULL THEN 'market_cap' END], lambda x: x IS NOT NULL), ',') AS repair FROM (
SELECT *, changed AND shares > 0 AS again FROM (SELECT x.*, f.volume AS nv, f.amount AS na, CASE WHEN h % 6 <> 0 THEN market_cap END AS cap, coalesce(abs(x.volume - f.volume) > 1e-9 + 1e-12*abs(f.volume), false) AS changed, x.amount IS NOT NULL AND f.amount IS NULL AS cleared, x.amount IS NULL AND f.amount IS NOT NULL AS filled,
 coalesce(h % 5 = 0 AND (h % 50 = 10 OR h % 35 <> 0) AND abs(x.amount - f.amount) > 0.01 + 1e-7*abs(f.amount), false) AS swapped, CASE WHEN h % 6 <> 0 THEN market_cap/close_raw ELSE x.volume*100/turnover END AS shares FROM units x JOIN vfixed f USING (code, date)))""",
    "vfixed",
)


FILL_DAY = "1996-07-01"


def fill_day(spark, d):
    b = bars(spark, d).selectExpr("code", "date", "CASE WHEN CAST(code AS BIGINT) % 3 = 0 THEN turnover END AS pcf")
    late = bars(spark, d).selectExpr("code", "date", "CASE WHEN CAST(code AS BIGINT) % 2 = 0 THEN 0D ELSE close END AS pcf", "2 AS seq")
    remote = late.unionByName(late.selectExpr("code", "date", "pcf * 2 AS pcf", "1 AS seq"))
    return out(q.fill_day(b, remote, "pcf", FILL_DAY), "*")


QUERIES["fill_day"] = fill_day
ORACLES["fill_day"] = sql(
    f"""SELECT code, date, {r('pcf')}, CAST(filled AS INT) AS filled FROM (SELECT code, date, filled, CASE WHEN filled THEN close WHEN CAST(code AS BIGINT) % 3 = 0 THEN turnover END AS pcf FROM (
SELECT *, date = DATE '{FILL_DAY}' AND CAST(code AS BIGINT) % 3 <> 0 AND CAST(code AS BIGINT) % 2 = 1 AS filled FROM bars))""",
    "bars",
)


def overlay(spark, d):
    b = bars(spark, d).select("code", "date", "close", "volume")
    corrected = b.filter("volume > 40").selectExpr("code", "date", "close * 2 AS close", "volume")
    few = corrected.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n < 20").select("code")
    return out(q.overlay(b, corrected.join(few, "code")), "*")


QUERIES["overlay"] = overlay
ORACLES["overlay"] = sql(
    f"""SELECT code, date, {r('close volume')}, replaced FROM (SELECT b.code, date, CASE WHEN n < 20 THEN close*2 ELSE close END AS close, volume, CAST(n < 20 AS INT) AS replaced FROM bars b
LEFT JOIN (SELECT code, count(*) AS n FROM bars WHERE volume > 40 GROUP BY code) c ON c.code = b.code WHERE n IS NULL OR n >= 20 OR volume > 40)""".replace("CAST(n < 20 AS INT)", "CAST(coalesce(n < 20, false) AS INT)"),
    "bars",
)
