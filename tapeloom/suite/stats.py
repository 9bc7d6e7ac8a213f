"""Factor research statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.quantiles import ks_distance
from tapeloom.operators import market, outcomes, pools, scoring, stats
from tapeloom.plans import brick as plan
from tapeloom.plans.panel import FACTORS, factor_panel
from tapeloom.session import cut_lineage
from tapeloom.suite.common import bars, out
from tapeloom.suite.market import _pool_features, _state
from tapeloom.suite.sqlbase import S, cte, i, r, sql
from tapeloom.suite.sqlbase import w as sw

QUERIES, ORACLES = {}, {}

cte(
    "panel",
    f"""SELECT *, date AS entry_date, ln(1 + return_pct/100) AS log_ret FROM (SELECT code, date, rn, volume/v20 AS vol_ratio, close/c5 - 1 AS mom5, (high - low)/close AS range_pct, abs(close - open)/open AS body_abs, volume_rank,
 avg(greatest(high - low, abs(high - coalesce(pc, high)), abs(low - coalesce(pc, low)))) OVER {sw(14)}/close AS atr_pct, (high - low)/pc/(volume_rank + 1e-6) AS range_efficiency, ld AS exit_date, (lc/close - 1)*100 AS return_pct
FROM (SELECT *, (len(list_filter(l, lambda x: x < volume)) + (len(list_filter(l, lambda x: x = volume)) + 1)/2.0)/len(l) AS volume_rank FROM (
SELECT *, row_number() OVER {S} AS rn, lag(close) OVER {S} AS pc, lag(close, 5) OVER {S} AS c5, avg(volume) OVER {sw(20)} AS v20, list(volume) OVER {sw(20)} AS l, lead(close) OVER {S} AS lc, lead(date) OVER {S} AS ld FROM bars))) WHERE return_pct IS NOT NULL""",
    "bars",
)


def panel(spark, d):
    return factor_panel(bars(spark, d))


def _ar(x, by):
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1)/2.0)" if by else f"(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1)/2.0)"


def _dic(f, label="return_pct", src="panel", least=5):
    return f"""SELECT * FROM (SELECT date, count(*) AS rows, corr(a, b) AS rank_ic FROM (SELECT date, {_ar(f, 'date')} AS a, {_ar(label, 'date')} AS b FROM {src} WHERE {f} IS NOT NULL AND {label} IS NOT NULL) GROUP BY date) WHERE rows >= {least} AND rank_ic IS NOT NULL AND NOT isnan(rank_ic)"""


def daily_rank_ic(spark, d):
    return out(stats.daily_rank_ic(panel(spark, d), "vol_ratio", "return_pct"), "*")


QUERIES["daily_rank_ic"] = daily_rank_ic
ORACLES["daily_rank_ic"] = sql(f"SELECT date, rows, {r('rank_ic')} FROM ({_dic('vol_ratio')})", "panel")


def rank_ic(spark, d):
    p = panel(spark, d)
    return out(stats.rank_ic(p, "body_abs", "return_pct"), "*")


QUERIES["rank_ic"] = rank_ic
ORACLES["rank_ic"] = sql(
    f"SELECT 'body_abs' AS factor, {r('ic_mean ic_std')}, n_dates FROM (SELECT avg(rank_ic) AS ic_mean, stddev_pop(rank_ic) AS ic_std, count(*) AS n_dates FROM ({_dic('body_abs')}))", "panel"
)


def score_agreement(spark, d):
    return out(stats.daily_rank_ic(panel(spark, d), "vol_ratio", "range_pct"), "*")


QUERIES["score_agreement"] = score_agreement
ORACLES["score_agreement"] = sql(f"SELECT date, rows, {r('rank_ic')} FROM ({_dic('vol_ratio', 'range_pct')})", "panel")


def feature_return_correlation(spark, d):
    return out(stats.pooled_spearman(panel(spark, d), FACTORS, "return_pct"), "*")


def _sp(f, label="return_pct"):
    return f"SELECT '{f}' AS factor, count(*) AS rows, corr(a, b) AS spearman FROM (SELECT {_ar(f, '')} AS a, {_ar(label, '')} AS b FROM panel WHERE {f} IS NOT NULL AND {label} IS NOT NULL)"


QUERIES["feature_return_correlation"] = feature_return_correlation
ORACLES["feature_return_correlation"] = sql(
    f"SELECT factor, rows, {r('spearman')} FROM ({' UNION ALL '.join(_sp(f) for f in FACTORS)}) WHERE rows >= 100", "panel"
)


def strongest_control(spark, d):
    return out(stats.strongest_control(panel(spark, d), "vol_ratio", [f for f in FACTORS if f != "vol_ratio"]), "*")


QUERIES["strongest_control"] = strongest_control
ORACLES["strongest_control"] = sql(
    f"SELECT factor AS control, {r('spearman')} FROM ({' UNION ALL '.join(_sp(f, 'vol_ratio') for f in FACTORS if f != 'vol_ratio')}) ORDER BY abs(round(spearman, 12)) DESC, factor DESC LIMIT 1", "panel"
)


def _resid(frame, least, default):
    return f"""SELECT *, CASE WHEN n >= {least} THEN coalesce(y - my - ba*(a - ma) - bb*(b - mb), {default}) ELSE {default} END AS residual, CASE WHEN n >= {least} AND cyy > 1e-12 THEN greatest(0, (ba*cay + bb*cby)/cyy) END AS residual_r2 FROM (
SELECT *, CASE WHEN det > 1e-18 THEN (cay*cbb - cby*cab)/det END AS ba, CASE WHEN det > 1e-18 THEN (cby*caa - cay*cab)/det END AS bb FROM (SELECT *, caa*cbb - cab*cab AS det FROM (
SELECT *, count(y) OVER f AS n, avg(y) OVER f AS my, avg(a) OVER f AS ma, avg(b) OVER f AS mb, covar_pop(a, a) OVER f AS caa, covar_pop(b, b) OVER f AS cbb, covar_pop(a, b) OVER f AS cab, covar_pop(a, y) OVER f AS cay, covar_pop(b, y) OVER f AS cby, covar_pop(y, y) OVER f AS cyy
FROM (SELECT code, date, body_abs AS y, volume_rank AS a, atr_pct AS b, log_ret, range_efficiency, return_pct FROM panel WHERE body_abs IS NOT NULL AND volume_rank IS NOT NULL AND atr_pct IS NOT NULL) WINDOW f AS {frame})))"""


def cross_section_residual(spark, d):
    p = stats.cross_section_residual(panel(spark, d), "body_abs", "volume_rank", "atr_pct", "residual", least=5)
    return out(p, "code date residual residual_r2")


QUERIES["cross_section_residual"] = cross_section_residual
ORACLES["cross_section_residual"] = sql(f"SELECT code, date, {r('residual residual_r2')} FROM ({_resid('(PARTITION BY date)', 5, '0')})", "panel")


def rolling_residual(spark, d):
    p = stats.rolling_residual(panel(spark, d), "body_abs", "volume_rank", "atr_pct", "residual")
    return out(p, "code date residual")


QUERIES["rolling_residual"] = rolling_residual
ORACLES["rolling_residual"] = sql(f"SELECT code, date, {r('residual')} FROM ({_resid(sw(60, 1), 20, 'NULL')})", "panel")


def erd_features(spark, d):
    p = stats.cross_section_residual(panel(spark, d), "body_abs", "volume_rank", "atr_pct", "residual", least=5)
    p = p.selectExpr("*", "-residual AS absorption", "-coalesce(range_efficiency, 0D) AS efficiency_score", "-residual * CASE WHEN volume_rank > 0.8 THEN 1D ELSE 0D END AS high_volume_absorption")
    return out(p, "code date body_abs atr_pct volume_rank absorption efficiency_score high_volume_absorption")


QUERIES["erd_features"] = erd_features
ORACLES["erd_features"] = sql(
    f"""SELECT code, date, {r('body_abs atr_pct volume_rank absorption efficiency_score high_volume_absorption')} FROM (SELECT code, date, y AS body_abs, b AS atr_pct, a AS volume_rank, -residual AS absorption, -coalesce(range_efficiency, 0) AS efficiency_score, -residual*CASE WHEN a > 0.8 THEN 1 ELSE 0 END AS high_volume_absorption FROM ({_resid('(PARTITION BY date)', 5, '0')}))""",
    "panel",
)


def residual_rank_ic(spark, d):
    return out(stats.residual_rank_ic(panel(spark, d), "body_abs", ["volume_rank", "atr_pct"], "return_pct", least=6), "*")


# Where one control is constant or follows the other, least squares fit on the control that varies more.
_LEAST_SQUARES = _resid("(PARTITION BY date)", 7, "NULL").replace("/det END AS ba", "/det WHEN caa >= cbb AND caa > 0 THEN cay/caa ELSE 0 END AS ba").replace(
    "/det END AS bb", "/det WHEN cbb > caa THEN cby/cbb ELSE 0 END AS bb"
)
QUERIES["residual_rank_ic"] = residual_rank_ic
ORACLES["residual_rank_ic"] = sql(
    f"""SELECT date, rows, {r('rank_ic r2')} FROM (SELECT date, count(*) AS rows, corr(ra, rb) AS rank_ic, any_value(residual_r2) AS r2 FROM (SELECT date, residual_r2, {_ar('residual', 'date')} AS ra, {_ar('return_pct', 'date')} AS rb FROM (
SELECT date, return_pct, residual_r2, round(residual, 13) AS residual FROM ({_LEAST_SQUARES})) WHERE residual IS NOT NULL) GROUP BY date)""",
    "panel",
)


def residual_rank_ic_many(spark, d):
    return out(stats.residual_rank_ic(panel(spark, d), "body_abs", ["volume_rank", "atr_pct", "vol_ratio", "mom5"], "return_pct", least=9), "*")


def _partialled(controls):
    """Residual of y on all controls by taking them out one after the other; a control that the ones before explain adds nothing."""
    frame = "OVER (PARTITION BY date)"
    table = f"SELECT date, return_pct, count(*) {frame} AS rows, " + ", ".join(
        f"{c} - avg({c}) {frame} AS {a}, sum(0.0) {frame} AS {a}_all" for c, a in [("body_abs", "y"), *((c, f"x{k}") for k, c in enumerate(controls))]
    )
    whole = ["body_abs", *controls]
    table += " FROM panel WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in [*whole, "return_pct"])
    names = ["y", *(f"x{k}" for k in range(len(controls)))]
    table = f"SELECT * REPLACE ({', '.join(f'sum({a}*{a}) {frame} AS {a}_all' for a in names)}) FROM ({table})"
    for k in range(len(controls)):
        rest = ["y", *(f"x{j}" for j in range(k + 1, len(controls)))]
        own = f"sum(x{k}*x{k}) {frame}"
        gone = ", ".join(f"CASE WHEN {own} > 1e-14*x{k}_all AND {own} > 0 THEN {a} - x{k}*sum({a}*x{k}) {frame}/{own} ELSE {a} END AS {a}" for a in rest)
        table = f"SELECT * REPLACE ({gone}) FROM ({table})"
    return f"SELECT date, rows, return_pct, y_all, y AS residual, sum(y*y) {frame} AS left_over FROM ({table})"


QUERIES["residual_rank_ic_many"] = residual_rank_ic_many
ORACLES["residual_rank_ic_many"] = sql(
    f"""SELECT date, rows, {r('rank_ic r2')} FROM (SELECT date, any_value(rows) AS rows, corr(ra, rb) AS rank_ic, any_value(greatest(0, 1 - left_over/y_all)) AS r2 FROM (SELECT *, {_ar('residual', 'date')} AS ra, {_ar('return_pct', 'date')} AS rb FROM (
SELECT * REPLACE (round(residual, 12) AS residual) FROM ({_partialled(['volume_rank', 'atr_pct', 'vol_ratio', 'mom5'])}) WHERE rows >= 9 AND y_all > 1e-12 AND sqrt(left_over/rows) > 1e-12)) GROUP BY date) WHERE rank_ic IS NOT NULL AND NOT isnan(rank_ic)""",
    "panel",
)


def label_bins(spark, d):
    p = panel(spark, d)
    return out(stats.label_bins(p, "return_pct", p.filter("date < DATE'1999-01-01'")), "code date label_bin")


QUERIES["label_bins"] = label_bins
ORACLES["label_bins"] = sql(
    """SELECT code, date, CAST(len(list_filter(q, lambda x: return_pct > x)) AS INT) AS label_bin FROM panel, (SELECT quantile_cont(return_pct, [0.2, 0.4, 0.6, 0.8]) AS q FROM panel WHERE date < DATE '1999-01-01')""",
    "panel",
)


def quintile_effect(spark, d):
    return out(stats.quintile_effect(panel(spark, d), FACTORS, "log_ret"), "*")


def _qe(f):
    return f"""SELECT '{f}' AS factor, count(*) AS rows, count(*) FILTER (x <= lo) AS q1_n, count(*) FILTER (x > hi) AS q5_n, avg(y) FILTER (x <= lo) AS q1_mean, avg(y) FILTER (x > hi) AS q5_mean, var_samp(y) FILTER (x <= lo) AS v1, var_samp(y) FILTER (x > hi) AS v5
FROM (SELECT {f} AS x, log_ret AS y FROM panel WHERE {f} IS NOT NULL), (SELECT quantile_cont({f}, 0.2) AS lo, quantile_cont({f}, 0.8) AS hi FROM panel)"""


QE = f"""SELECT factor, rows, q1_n, q5_n, q1_mean, q5_mean, (q5_mean - q1_mean)/sqrt(((q5_n - 1)*v5 + (q1_n - 1)*v1)/(q1_n + q5_n - 2)) AS cohen_d, (q5_mean - q1_mean)/sqrt(v1/q1_n + v5/q5_n) AS welch_t,
 pow(v1/q1_n + v5/q5_n, 2)/(pow(v1/q1_n, 2)/(q1_n - 1) + pow(v5/q5_n, 2)/(q5_n - 1)) AS welch_df FROM ({' UNION ALL '.join(_qe(f) for f in FACTORS)})"""
QUERIES["quintile_effect"] = quintile_effect
ORACLES["quintile_effect"] = sql(f"SELECT factor, rows, q1_n, q5_n, {r('q1_mean q5_mean cohen_d welch_t welch_df')} FROM ({QE})", "panel")


def bh_adjust(spark, d):
    """Chebyshev bounds of the effect sizes as p values."""
    q = stats.quintile_effect(panel(spark, d), FACTORS, "log_ret").selectExpr("factor", "least(1D, round(1 / (welch_t * welch_t), 9)) AS p_value")
    return out(stats.bh_adjust(q), "*")


QUERIES["bh_adjust"] = bh_adjust
ORACLES["bh_adjust"] = sql(
    f"""SELECT factor, {r('p_value p_adjusted')} FROM (SELECT *, least(1, min(p_value*n/k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adjusted FROM (
SELECT *, row_number() OVER (ORDER BY p_value, factor) AS k, count(*) OVER () AS n FROM (SELECT factor, least(1, round(1/(welch_t*welch_t), 9)) AS p_value FROM ({QE}))))""",
    "panel",
)


def bootstrap_delta(spark, d):
    ic = stats.daily_rank_ic(panel(spark, d), "vol_ratio", "return_pct")
    return out(stats.bootstrap_delta(ic, "rank_ic", "year(date) % 2 = 0", "date"), "*")


QUERIES["bootstrap_delta"] = bootstrap_delta
ORACLES["bootstrap_delta"] = sql(
    f"""SELECT {r('delta ci_low ci_high p_value')} FROM (WITH s AS (SELECT rank_ic AS v, year(date) % 2 = 0 AS hi, row_number() OVER (PARTITION BY year(date) % 2 = 0 ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY year(date) % 2 = 0) AS n FROM ({_dic('vol_ratio')})),
 m AS (SELECT draw, avg(b.v) FILTER (b.hi) - avg(b.v) FILTER (NOT b.hi) AS dl FROM (SELECT hi, draw, ((draw*48271 + i*69621 + draw*i*16807 + CAST(hi AS INT)*131) % 2147483647) % n AS pick FROM s, range(1, 201) t(draw)) p JOIN s b ON b.hi = p.hi AND b.i = p.pick GROUP BY draw)
SELECT (SELECT avg(v) FILTER (hi) - avg(v) FILTER (NOT hi) FROM s) AS delta, quantile_cont(dl, 0.025) AS ci_low, quantile_cont(dl, 0.975) AS ci_high, least(1, 2*least(avg(CASE WHEN dl <= 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN dl >= 0 THEN 1.0 ELSE 0 END))) AS p_value FROM m)""",
    "panel",
)


def preflight_cells(spark, d):
    return out(stats.preflight_cells(panel(spark, d), "vol_ratio", "return_pct", _state(spark, d), "state_score", cells=9), "*")


QUERIES["preflight_cells"] = preflight_cells
ORACLES["preflight_cells"] = sql(
    f"""SELECT 'vol_ratio' AS factor, low_n, mid_n, high_n, {r('low_mean mid_mean high_mean delta welch_t bonferroni_level')} FROM (SELECT *, high_mean - low_mean AS delta, (high_mean - low_mean)/sqrt(hv/high_n + lv/low_n) AS welch_t, 0.05/9 AS bonferroni_level FROM (
SELECT count(*) FILTER (b = 'low') AS low_n, count(*) FILTER (b = 'mid') AS mid_n, count(*) FILTER (b = 'high') AS high_n, avg(rank_ic) FILTER (b = 'low') AS low_mean, avg(rank_ic) FILTER (b = 'mid') AS mid_mean, avg(rank_ic) FILTER (b = 'high') AS high_mean, var_samp(rank_ic) FILTER (b = 'high') AS hv, var_samp(rank_ic) FILTER (b = 'low') AS lv
FROM (SELECT rank_ic, CASE WHEN state_score <= q[1] THEN 'low' WHEN state_score <= q[2] THEN 'mid' ELSE 'high' END AS b FROM (SELECT *, (SELECT quantile_cont(state_score, [1/3.0, 2/3.0]) FROM ({_dic('vol_ratio')}) JOIN msp USING (date)) AS q FROM ({_dic('vol_ratio')}) JOIN msp USING (date)) WHERE state_score IS NOT NULL)))""",
    "panel",
    "msp",
)

PRE = ["vol_ratio", "mom5", "range_pct"]


def prescreen(spark, d):
    return out(stats.prescreen(panel(spark, d), PRE, "return_pct", "date < DATE'1999-01-01'"), "*")


QUERIES["prescreen"] = prescreen
ORACLES["prescreen"] = sql(
    f"""SELECT factor, non_null, distinct_values, {r('coverage_pct std spearman orientation')}, CAST(coverage_pct >= 80 AND std > 1e-12 AND abs(spearman) > 0.01 AS INT) AS passed FROM (SELECT *, sign(spearman) AS orientation FROM ({' UNION ALL '.join(
        f"SELECT '{f}' AS factor, count({f}) AS non_null, count({f})*100.0/count(*) AS coverage_pct, count(DISTINCT {f}) AS distinct_values, stddev_samp({f}) AS std, (SELECT corr(a, b) FROM (SELECT {_ar(f, '')} AS a, {_ar('return_pct', '')} AS b FROM panel WHERE {f} IS NOT NULL AND date < DATE '1999-01-01')) AS spearman FROM panel WHERE date < DATE '1999-01-01'" for f in PRE)}))""",
    "panel",
)


def coverage_report(spark, d):
    return out(stats.coverage_report(panel(spark, d), ["mom5", "range_efficiency", "atr_pct"], 12), "*")


QUERIES["coverage_report"] = coverage_report
ORACLES["coverage_report"] = sql(
    f"SELECT feature, non_null, distinct_values, {r('coverage_pct std')} FROM ({' UNION ALL '.join(f'''SELECT '{f}' AS feature, count({f}) AS non_null, count({f})*100.0/count(*) AS coverage_pct, count(DISTINCT round({f}, 12)) AS distinct_values, stddev_samp({f}) AS std FROM panel''' for f in ('mom5', 'range_efficiency', 'atr_pct'))})",
    "panel",
)

FOLDS = stats.walk_forward_folds(1995, 1998, 2)
FOLD_ROWS = ", ".join(f"('{f['fold']}', DATE '{f['train_from']}', DATE '{f['train_to']}', DATE '{f['test_from']}', DATE '{f['test_to']}')" for f in FOLDS)
cte(
    "folded",
    f"""SELECT * FROM (SELECT p.*, fold, c AS test_from, CASE WHEN entry_date BETWEEN a AND b THEN 'train' ELSE 'test' END AS role FROM panel p JOIN (VALUES {FOLD_ROWS}) v(fold, a, b, c, d) ON entry_date BETWEEN a AND b OR entry_date BETWEEN c AND d) f
WHERE role = 'test' OR (exit_date < test_from AND entry_date NOT IN (SELECT entry_date FROM (SELECT fold, entry_date, row_number() OVER (PARTITION BY fold ORDER BY entry_date DESC) AS k FROM (
 SELECT DISTINCT fold, entry_date FROM panel JOIN (VALUES {FOLD_ROWS}) v(fold, a, b, c, d) ON entry_date BETWEEN a AND b)) e WHERE k <= 5 AND e.fold = f.fold))""",
    "panel",
)


def folds_purged(spark, d):
    f = stats.purge_embargo(stats.assign_folds(panel(spark, d), FOLDS))
    return f.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("entry_date").alias("first_day"), F.max("entry_date").alias("last_day"))


QUERIES["folds_purged"] = folds_purged
ORACLES["folds_purged"] = sql("SELECT fold, role, count(*) AS n, min(entry_date) AS first_day, max(entry_date) AS last_day FROM folded GROUP BY ALL", "folded")


def fold_deltas(spark, d):
    f = stats.purge_embargo(stats.assign_folds(panel(spark, d), FOLDS)).filter("role = 'test'")
    base = f.groupBy("fold").agg(F.avg("log_ret").alias("m"))
    cand = f.filter("vol_ratio < 1").groupBy("fold").agg(F.avg("log_ret").alias("m"))
    return out(stats.fold_deltas(base, cand, "m"), "*")


QUERIES["fold_deltas"] = fold_deltas
ORACLES["fold_deltas"] = sql(
    f"""SELECT count(*) AS windows, count(*) FILTER (dl > 0) AS wins, round(min(dl), 6) + 0.0 AS worst, round(avg(dl), 6) + 0.0 AS mean_delta FROM (SELECT fold, avg(log_ret) FILTER (vol_ratio < 1) - avg(log_ret) AS dl FROM folded WHERE role = 'test' GROUP BY fold)""",
    "folded",
)


def ndcg(spark, d):
    p = panel(spark, d)
    p = stats.label_bins(p, "return_pct", p.filter("date < DATE'1999-01-01'"))
    return out(stats.ndcg(p, "vol_ratio", "label_bin", by="date"), "*")


QUERIES["ndcg"] = ndcg
ORACLES["ndcg"] = sql(
    f"""SELECT {r('ndcg_at_3 ndcg_at_5 ndcg_at_10')} FROM (SELECT {", ".join(f"avg(CASE WHEN m{k} > 0 THEN d{k}/m{k} END) AS ndcg_at_{k}" for k in (3, 5, 10))} FROM (
SELECT date, count(*) AS n, {", ".join(f"sum(CASE WHEN rr <= {k} THEN (pow(2, l) - 1)/log2(rr + 1) ELSE 0 END) AS d{k}, sum(CASE WHEN ri <= {k} THEN (pow(2, l) - 1)/log2(ri + 1) ELSE 0 END) AS m{k}" for k in (3, 5, 10))} FROM (
SELECT date, l, row_number() OVER (PARTITION BY date ORDER BY round(vol_ratio, 12) DESC, code) AS rr, row_number() OVER (PARTITION BY date ORDER BY l DESC, code) AS ri FROM (
SELECT code, date, vol_ratio, len(list_filter(q, lambda x: return_pct > x)) AS l FROM panel, (SELECT quantile_cont(return_pct, [0.2, 0.4, 0.6, 0.8]) AS q FROM panel WHERE date < DATE '1999-01-01'))) GROUP BY date HAVING n >= 2))""",
    "panel",
)


def _held(spark, d):
    return plan.closed_trades(bars(spark, d)).selectExpr("code", "entry_date", "hold_days", "return_pct")


cte(
    "hres",
    """SELECT h.*, return_pct - (my + CASE WHEN n >= 20 THEN coalesce(s, 0) ELSE 0 END*(hold_days - mx)) AS residual FROM (SELECT code, entry_date, hold_days, return_pct, len(list_filter(e, lambda x: hold_days >= x)) AS hold_bin FROM closed, (SELECT list_distinct(quantile_cont(hold_days, [0.25, 0.5, 0.75])) AS e FROM closed)) h
JOIN (SELECT hold_bin, count(*) AS n, CASE WHEN var_pop(hold_days) > 0 THEN regr_slope(return_pct, hold_days) END AS s, avg(return_pct) AS my, avg(hold_days) AS mx FROM (SELECT hold_days, return_pct, len(list_filter(e, lambda x: hold_days >= x)) AS hold_bin FROM closed, (SELECT list_distinct(quantile_cont(hold_days, [0.25, 0.5, 0.75])) AS e FROM closed)) GROUP BY hold_bin) USING (hold_bin)""",
    "closed",
)


def hold_days_residual(spark, d):
    return out(stats.hold_days_residual(_held(spark, d)), "code entry_date hold_bin residual")


QUERIES["hold_days_residual"] = hold_days_residual
ORACLES["hold_days_residual"] = sql(f"SELECT code, entry_date, CAST(hold_bin AS INT) AS hold_bin, {r('residual')} FROM hres", "hres")


def residualizer_check(spark, d):
    return out(stats.residualizer_check(stats.hold_days_residual(_held(spark, d))), "*")


QUERIES["residualizer_check"] = residualizer_check
ORACLES["residualizer_check"] = sql(
    f"""SELECT CAST(n AS BIGINT) AS n, bins, {r('mean_t levene r2')} FROM (SELECT sum(n) AS n, count(*) AS bins, (SELECT avg(residual)/(stddev_samp(residual)/sqrt(count(*))) FROM hres) AS mean_t, (sum(n) - count(*))*(sum(n*mz*mz) - sum(n)*pow(sum(n*mz)/sum(n), 2))/((count(*) - 1)*sum(n*vz)) AS levene,
 (SELECT 1 - var_pop(residual)/var_pop(return_pct) FROM hres) AS r2 FROM (SELECT hold_bin, count(*) AS n, avg(z) AS mz, var_pop(z) AS vz FROM (SELECT hold_bin, abs(residual - median(residual) OVER (PARTITION BY hold_bin)) AS z FROM hres) GROUP BY hold_bin))""",
    "hres",
)


def ratio_residual(spark, d):
    return out(stats.ratio_residual(panel(spark, d), "vol_ratio", "range_pct", "date < DATE'1999-01-01'", "residual"), "code date residual")


QUERIES["ratio_residual"] = ratio_residual
ORACLES["ratio_residual"] = sql(
    f"SELECT code, date, {r('residual')} FROM (SELECT code, date, vol_ratio - (my + s*(range_pct - mx)) AS residual FROM panel, (SELECT regr_slope(vol_ratio, range_pct) AS s, avg(vol_ratio) AS my, avg(range_pct) AS mx FROM panel WHERE date < DATE '1999-01-01'))", "panel"
)


def placebo(spark, d):
    return out(stats.placebo(panel(spark, d).select("code", "date", "vol_ratio", "range_pct"), ["vol_ratio", "range_pct"], 11), "*")


QUERIES["placebo"] = placebo
ORACLES["placebo"] = sql(
    f"""SELECT a.code, a.date, round(b.vol_ratio, 6) AS vol_ratio, round(b.range_pct, 6) AS range_pct FROM (SELECT code, date, row_number() OVER (PARTITION BY date ORDER BY code) AS k FROM panel) a
JOIN (SELECT *, row_number() OVER (PARTITION BY date ORDER BY md5(code || '|11')) AS k FROM panel) b USING (date, k)""",
    "panel",
)


def ks_two_sample(spark, d):
    return out(ks_distance(panel(spark, d).withColumn("factor", F.lit("vol_ratio")), ["factor"], "vol_ratio", "date < DATE'1999-01-01'"), "*")


QUERIES["ks_two_sample"] = ks_two_sample
ORACLES["ks_two_sample"] = sql(
    f"""SELECT 'vol_ratio' AS factor, CAST(max(ta) AS BIGINT) AS n_left, CAST(max(tb) AS BIGINT) AS n_right, round(max(abs(ca/ta - cb/tb)), 6) AS ks FROM (SELECT sum(CAST(l AS INT)) OVER w AS ca, sum(CAST(NOT l AS INT)) OVER w AS cb, sum(CAST(l AS INT)) OVER () AS ta, sum(CAST(NOT l AS INT)) OVER () AS tb
FROM (SELECT vol_ratio, date < DATE '1999-01-01' AS l FROM panel) WINDOW w AS (ORDER BY vol_ratio RANGE UNBOUNDED PRECEDING))""",
    "panel",
)


def robust_scale(spark, d):
    return out(stats.robust_scale(panel(spark, d).select("code", "date", "vol_ratio", "range_pct"), ["vol_ratio", "range_pct"], "date < DATE'1999-01-01'"), "*")


QUERIES["robust_scale"] = robust_scale
ORACLES["robust_scale"] = sql(
    f"""SELECT code, date, {r('vol_ratio range_pct')} FROM (SELECT code, date, (vol_ratio - v[2])/(v[3] - v[1]) AS vol_ratio, (range_pct - g[2])/(g[3] - g[1]) AS range_pct FROM panel, (SELECT quantile_cont(vol_ratio, [0.25, 0.5, 0.75]) AS v, quantile_cont(range_pct, [0.25, 0.5, 0.75]) AS g FROM panel WHERE date < DATE '1999-01-01'))""",
    "panel",
)


def rank_model(spark, d):
    """Scores of out-of-sample rows from boosted trees on the label bins."""
    p = panel(spark, d).filter("mom5 IS NOT NULL")
    train = p.filter("date < DATE'1999-01-01'")
    model = stats.rank_model(stats.label_bins(train, "return_pct", train), ["vol_ratio", "mom5", "range_pct"], "label_bin", rounds=3, depth=3)
    return model.transform(p.filter("date >= DATE'1999-01-01'")).select("code", "date", "score")


QUERIES["rank_model"] = rank_model

GRID = [{"id": k, "gain": g, "ratio": q} for k, (g, q) in enumerate(((0.0, 1.0), (0.2, 1.0), (0.0, 1.5), (0.2, 2.0)), start=1)]


def parameter_grid(spark, d):
    t = plan.closed_trades(bars(spark, d))
    return out(stats.parameter_grid(t, GRID, "red_height / 100 >= p.gain AND vol_ratio_20 <= p.ratio"), "*")


QUERIES["parameter_grid"] = parameter_grid
ORACLES["parameter_grid"] = sql(
    f"""SELECT CAST(id AS INT) AS param_id, trades, entry_days, {r('win_rate_pct avg_return_pct median_return_pct std_return_pct avg_hold_days')} FROM (SELECT id, count(*) AS trades, count(DISTINCT entry_date) AS entry_days, 100*avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0 END) AS win_rate_pct, avg(return_pct) AS avg_return_pct, median(return_pct) AS median_return_pct,
 coalesce(stddev_samp(return_pct), 0) AS std_return_pct, avg(hold_days) AS avg_hold_days FROM closed JOIN (VALUES (1, 0.0, 1.0), (2, 0.2, 1.0), (3, 0.0, 1.5), (4, 0.2, 2.0)) pg(id, min_gain, max_ratio) ON red_height/100 >= min_gain AND vol_ratio_20 <= max_ratio GROUP BY id)""",
    "closed",
)


def hold_decay_weight(spark, d):
    return out(stats.hold_decay_weight(_held(spark, d), 0.05), "code entry_date hold_days sample_weight")


QUERIES["hold_decay_weight"] = hold_decay_weight
ORACLES["hold_decay_weight"] = sql("SELECT code, entry_date, hold_days, round(exp(-0.05*hold_days), 6) AS sample_weight FROM closed", "closed")


def regime_delta(spark, d):
    s = scoring.dimension_score(_pool_features(spark, d))
    other = s.selectExpr("* EXCEPT (score)", "CAST(vol_ratio_20 AS DOUBLE) AS score")
    return out(stats.regime_delta(s, other), "*")


QUERIES["regime_delta"] = regime_delta
ORACLES["regime_delta"] = sql(
    f"""SELECT CAST(regime_label AS DOUBLE) AS regime_label, {r('baseline candidate delta')} FROM (SELECT regime_label, avg(return_pct) FILTER (a <= 3) AS baseline, avg(return_pct) FILTER (b <= 3) AS candidate, avg(return_pct) FILTER (b <= 3) - avg(return_pct) FILTER (a <= 3) AS delta FROM (
SELECT p.regime_label, s.return_pct, row_number() OVER (PARTITION BY s.entry_date ORDER BY round(s.score, 12) DESC, s.code) AS a, row_number() OVER (PARTITION BY s.entry_date ORDER BY round(s.vol_ratio_20, 12) DESC, s.code) AS b FROM scored s JOIN pf p ON p.code = s.code AND p.signal_date = s.signal_date) GROUP BY regime_label)""",
    "scored",
    "pf",
)


BUCKETS = ("small", "medium", "large")


def bucketed_nav(spark, d):
    """Net value by pool size. Prices of the given tables jump by multiples, so returns and ratios are compared as signed logarithms."""
    from tapeloom.suite.market import _signals

    t = cut_lineage(pools.pool_size_bucket(pools.peer_relative(_signals(spark, d).filter("status = 'closed'"))))
    b = bars(spark, d)
    parts = [outcomes.daily_returns(t.filter(f"pool_size_bucket = '{k}'"), b).withColumn("bucket", F.lit(k)) for k in BUCKETS]
    m = outcomes.nav_metrics(parts[0].unionByName(parts[1]).unionByName(parts[2]), "bucket")
    logs = [f"signum({c}) * ln(1 + abs({c})) AS {c}" for c in ("cum_return_pct", "cagr_pct", "sharpe", "calmar")]
    return out(m.selectExpr("bucket", "days", "max_drawdown_pct", "daily_win_pct", "daily_avg_pct", *logs), "*")


def _bucket_sql(k):
    from tapeloom.suite.brick import NAV_METRICS
    from tapeloom.suite.sqlbase import CTES

    sizes = "SELECT signal_date, count(*) AS s FROM sig WHERE status = 'closed' GROUP BY 1"
    low, high = (f"(SELECT quantile_cont(s, {n}/3.0) FROM ({sizes}))" for n in (1, 2))
    bound = {"small": f"s <= {low}", "medium": f"s > {low} AND s <= {high}", "large": f"s > {high}"}[k]
    steps = ", ".join(f"{n} AS ({CTES[n][1]})" for n in ("held", "posret", "daily", "nav"))
    mine = f"mine AS (SELECT t.* FROM sig t JOIN ({sizes}) USING (signal_date) WHERE status = 'closed' AND {bound})"
    return f"SELECT '{k}' AS bucket, * FROM (WITH {mine}, {steps.replace('FROM closed', 'FROM mine')} {NAV_METRICS})"


QUERIES["bucketed_nav"] = bucketed_nav
ORACLES["bucketed_nav"] = sql(
    f"""SELECT bucket, days, {r('max_drawdown_pct daily_win_pct daily_avg_pct')}, {', '.join(f"round(sign({c}) * ln(1 + abs({c})), 6) AS {c}" for c in ("cum_return_pct", "cagr_pct", "sharpe", "calmar"))}
FROM ({' UNION ALL '.join(map(_bucket_sql, BUCKETS))}) WHERE days > 0""",
    "sig",
    "bars",
)
