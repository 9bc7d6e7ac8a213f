"""Factor research: information coefficients, residuals, effects, folds, labels and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import windows as w
from tapeloom.functions.positions import with_positions
from tapeloom.functions.quantiles import exact_quantiles, pair_spearman
from tapeloom.functions.ranks import top_n


def daily_rank_ic(df: DataFrame, factor: str, label: str, by: str = "date", least: int = 5) -> DataFrame:
    """Spearman correlation of factor and label in each session with at least ``least`` rows."""
    return pair_spearman(df, [by], factor, label).withColumnRenamed("spearman", "rank_ic").filter(f"rows >= {least} AND rank_ic IS NOT NULL")


def rank_ic(df: DataFrame, factor: str, label: str, by: str = "date", least: int = 5) -> DataFrame:
    return daily_rank_ic(df, factor, label, by, least).agg(
        F.avg("rank_ic").alias("ic_mean"), F.stddev_pop("rank_ic").alias("ic_std"), F.count(F.lit(1)).alias("n_dates")
    ).select(F.lit(factor).alias("factor"), "ic_mean", "ic_std", "n_dates")


def pooled_spearman(df: DataFrame, factors: Sequence[str], label: str, least: int = 100) -> DataFrame:
    """Spearman correlation over all rows, one line per factor.

    Factors become rows, and ranks come from value counts, so no rank runs in a single task.
    """
    entries = ", ".join(f"struct('{f}' AS factor, CAST({f} AS DOUBLE) AS x)" for f in factors)
    long = df.selectExpr(f"CAST({label} AS DOUBLE) AS y", f"explode(array({entries})) AS e").selectExpr(
        "e.factor AS factor", "e.x AS x", "y"
    ).filter("x IS NOT NULL AND y IS NOT NULL")
    return pair_spearman(long, ["factor"], "x", "y").filter(f"rows >= {least}")


def strongest_control(df: DataFrame, factor: str, controls: Sequence[str], least: int = 100) -> DataFrame:
    """The control with the largest absolute Spearman correlation to ``factor``."""
    each = pooled_spearman(df, controls, factor, least)
    return each.agg(
        F.expr("max_by(factor, struct(abs(round(spearman, 12)), factor))").alias("control"),
        F.expr("max_by(spearman, struct(abs(round(spearman, 12)), factor))").alias("spearman"),
    )


def cross_section_residual(df: DataFrame, y: str, x1: str, x2: str, out: str, by: str = "date", least: int = 20) -> DataFrame:
    """Residual of a daily regression on two variables, from moments of the session; 0 if too few.

    Also adds the session's R2 as ``<out>_r2``.
    """
    return _two_variable_residual(df, y, x1, x2, out, w.group(by), least, "0D")


def rolling_residual(df: DataFrame, y: str, x1: str, x2: str, out: str, lookback: int = 60, least: int = 20) -> DataFrame:
    """Residual against a regression on the previous ``lookback`` rows, the current one excluded."""
    return _two_variable_residual(df, y, x1, x2, out, w.rows(lookback, 1), least, "NULL")


def _two_variable_residual(df, y, x1, x2, out, frame, least, default):
    ok = f"{y} IS NOT NULL AND {x1} IS NOT NULL AND {x2} IS NOT NULL"
    v = {k: f"CASE WHEN {ok} THEN CAST({e} AS DOUBLE) END" for k, e in (("y", y), ("a", x1), ("b", x2))}
    m = df.selectExpr("*", *[f"{e} AS _{k}" for k, e in v.items()]).selectExpr(
        "*",
        f"count(_y) {frame} AS _n",
        *[f"avg(_{k}) {frame} AS _m{k}" for k in "yab"],
        *[f"covar_pop(_{p}, _{q}) {frame} AS _c{p}{q}" for p, q in ("aa", "bb", "ab", "ay", "by", "yy")],
    )
    m = m.selectExpr("*", "_caa * _cbb - _cab * _cab AS _det")
    m = m.selectExpr(
        "*",
        "CASE WHEN _det > 1e-18D THEN (_cay * _cbb - _cby * _cab) / _det END AS _ba",
        "CASE WHEN _det > 1e-18D THEN (_cby * _caa - _cay * _cab) / _det END AS _bb",
    )
    return m.selectExpr(
        *df.columns,
        f"CASE WHEN _n >= {least} THEN coalesce(_y - _my - _ba * (_a - _ma) - _bb * (_b - _mb), {default}) ELSE {default} END AS {out}",
        f"CASE WHEN _n >= {least} AND _cyy > 1e-12D THEN greatest(0D, (_ba * _cay + _bb * _cby) / _cyy) END AS {out}_r2",
    )


def residual_rank_ic(df: DataFrame, factor: str, controls: Sequence[str], label: str, by: str = "date", least: int = 35) -> DataFrame:
    """Daily rank IC of the part of ``factor`` that the controls do not explain.

    A session's means and covariances are aggregates; one row a session is solved for the coefficients, rows get their residuals by an
    expression, rounded to twelve digits, and are ranked by value counts. So no task holds a session.
    """
    names = [f"_x{i}" for i in range(len(controls))]
    every = ["_y", "_l", *names]
    need = max(least, len(names) + 5)
    cols = [F.col(by), F.col(factor).cast("double").alias("_y"), F.col(label).cast("double").alias("_l")]
    rows = df.select(*cols, *[F.col(c).cast("double").alias(n) for c, n in zip(controls, names)]).filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in every))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    moments = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_y").alias("_my"), F.var_pop("_y").alias("_yy"), *[F.avg(n).alias(f"_m{n}") for n in names],
        *[F.covar_pop(a, b).alias(f"{a}{b}") for a, b in pairs], *[F.covar_pop(n, "_y").alias(f"{n}_y") for n in names],
    ).filter(f"_n >= {need} AND _yy * _n > 1e-12D")

    def solve(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            t = batch.to_pandas()
            k = len(names)
            c = np.zeros((len(t), k, k))
            for a, b in pairs:
                i, j = names.index(a), names.index(b)
                c[:, i, j] = c[:, j, i] = t[f"{a}{b}"]
            xy = t[[f"{n}_y" for n in names]].to_numpy(float).reshape(len(t), k)
            # Controls of different size are scaled first; what they do not span gets the shortest solution.
            size = np.sqrt(np.maximum(np.einsum("nii->ni", c), 1e-300))
            slopes = np.einsum("nij,nj->ni", np.linalg.pinv(c / size[:, :, None] / size[:, None, :], rcond=1e-12, hermitian=True), xy / size) / size
            explained = (slopes * xy).sum(axis=1)
            base = t["_my"].to_numpy(float) - (slopes * t[[f"_m{n}" for n in names]].to_numpy(float).reshape(len(t), k)).sum(axis=1)
            yy = t["_yy"].to_numpy(float)
            made = [batch.column(0), pa.array(base), pa.array(list(slopes), pa.list_(pa.float64())), pa.array(np.maximum(0.0, explained / yy)), pa.array(np.sqrt(np.maximum(yy - explained, 0)))]
            yield pa.RecordBatch.from_arrays(made, names=[by, "_base", "_slopes", "r2", "_left"])

    solved = moments.mapInArrow(solve, f"{by} {df.schema[by].dataType.simpleString()}, _base double, _slopes array<double>, r2 double, _left double").filter("_left > 1e-12D")
    explained = " + ".join(["_base", *[f"_slopes[{i}] * {n}" for i, n in enumerate(names)]])
    left = rows.join(solved.select(by, "_base", "_slopes"), by).selectExpr(by, "_l", f"round(_y - ({explained}), 12) AS _e")
    ic = pair_spearman(left, [by], "_e", "_l").withColumnRenamed("spearman", "rank_ic")
    return ic.join(solved.select(by, "r2"), by).select(by, "rows", "rank_ic", "r2").filter("rank_ic IS NOT NULL")


def label_bins(df: DataFrame, value: str, train: DataFrame, out: str = "label_bin", shares=(0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """Number of training quantiles that the value exceeds."""
    names = {f"q{i}": s for i, s in enumerate(shares)}
    edges = exact_quantiles(train, [], value, names).select(F.array(*names)).scalar()
    return df.withColumn("_e", edges).selectExpr(*df.columns, f"size(filter(_e, x -> {value} > x)) AS {out}")


def quintile_effect(df: DataFrame, factors: Sequence[str], label: str, least: int = 100) -> DataFrame:
    """Top against bottom quintile of each factor: means, Cohen's d, Welch t and its degrees of freedom."""
    entries = ", ".join(f"struct('{f}' AS factor, CAST({f} AS DOUBLE) AS x)" for f in factors)
    long = df.selectExpr(f"CAST({label} AS DOUBLE) AS y", f"explode(array({entries})) AS e").selectExpr(
        "e.factor AS factor", "e.x AS x", "y"
    ).filter("x IS NOT NULL AND y IS NOT NULL")
    edges = exact_quantiles(long, ["factor"], "x", {"lo": 0.2, "hi": 0.8})
    sides = long.join(edges, "factor").groupBy("factor").agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.expr(f"{fn}(CASE WHEN {cond} THEN y END)").alias(f"{q}_{nm}")
            for q, cond in (("q1", "x <= lo"), ("q5", "x > hi"))
            for fn, nm in (("count", "n"), ("avg", "mean"), ("var_samp", "var"))
        ],
    ).filter(f"rows >= {least} AND q1_n > 1 AND q5_n > 1")
    a, b = "q1_var / q1_n", "q5_var / q5_n"
    return sides.selectExpr(
        "factor",
        "rows",
        "q1_n",
        "q5_n",
        "q1_mean",
        "q5_mean",
        "try_divide(q5_mean - q1_mean, sqrt(((q5_n - 1) * q5_var + (q1_n - 1) * q1_var) / (q1_n + q5_n - 2))) AS cohen_d",
        f"try_divide(q5_mean - q1_mean, sqrt({a} + {b})) AS welch_t",
        f"try_divide(pow({a} + {b}, 2), pow({a}, 2) / (q1_n - 1) + pow({b}, 2) / (q5_n - 1)) AS welch_df",
    )


def bh_adjust(df: DataFrame, p: str = "p_value", name: str = "factor") -> DataFrame:
    """Benjamini-Hochberg adjusted values. One row per hypothesis, so the window is short."""
    ranked = df.selectExpr("*", f"row_number() OVER (ORDER BY {p}, {name}) AS _k", "count(1) OVER (PARTITION BY 1) AS _n")
    adjusted = f"least(1D, min({p} * _n / _k) OVER (ORDER BY _k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
    return ranked.selectExpr(*df.columns, f"{adjusted} AS p_adjusted")


def bootstrap_delta(df: DataFrame, value: str, is_high: str, order: str, draws: int = 200, least: int = 10) -> DataFrame:
    """Difference of means of two samples with resampled interval and two-sided share.

    ``df`` holds one row per session. Each drawn slot picks its row by arithmetic on (draw, slot), so
    the draws repeat; the picks are an equi-join on the row number.
    """
    rows = df.selectExpr(
        f"CAST({value} AS DOUBLE) AS v", f"({is_high}) AS hi", f"row_number() OVER (PARTITION BY ({is_high}) ORDER BY {order}) - 1 AS i"
    ).filter("v IS NOT NULL AND hi IS NOT NULL")
    rows = rows.selectExpr("*", "count(1) OVER (PARTITION BY hi) AS n")
    slots = rows.selectExpr("hi", "i AS slot", "n", f"explode(sequence(1, {draws})) AS draw").selectExpr(
        "hi",
        "draw",
        "pmod((draw * 48271L + slot * 69621L + draw * slot * 16807L + CAST(hi AS INT) * 131L) % 2147483647L, n) AS i",
    )
    means = slots.join(rows.select("hi", "i", "v"), ["hi", "i"]).groupBy("draw").agg(
        F.expr("avg(CASE WHEN hi THEN v END) - avg(CASE WHEN NOT hi THEN v END)").alias("delta")
    )
    seen = rows.agg(
        F.expr("avg(CASE WHEN hi THEN v END) - avg(CASE WHEN NOT hi THEN v END)").alias("delta"),
        F.expr("least(count_if(hi), count_if(NOT hi))").alias("n"),
    )
    stats = means.agg(
        F.percentile("delta", F.lit(0.025)).alias("ci_low"),
        F.percentile("delta", F.lit(0.975)).alias("ci_high"),
        F.expr("least(1D, 2 * least(avg(CASE WHEN delta <= 0 THEN 1D ELSE 0D END), avg(CASE WHEN delta >= 0 THEN 1D ELSE 0D END)))").alias("p_value"),
    )
    observed = seen.select(F.struct("delta", "n")).scalar()
    return stats.withColumn("_o", observed).selectExpr("_o.delta AS delta", "ci_low", "ci_high", "p_value", "_o.n AS n").filter(f"n >= {least}").drop("n")


# --- folds -------------------------------------------------------------------------------------


def walk_forward_folds(first_year: int, last_year: int, train_years: int = 3) -> list[dict]:
    """Fold definitions: ``train_years`` calendar years, then one test year."""
    return [
        {
            "fold": f"{y}-{y + train_years - 1}/{y + train_years}",
            "train_from": f"{y}-01-01",
            "train_to": f"{y + train_years - 1}-12-31",
            "test_from": f"{y + train_years}-01-01",
            "test_to": f"{y + train_years}-12-31",
        }
        for y in range(first_year, last_year + 1)
    ]


def assign_folds(df: DataFrame, folds: Sequence[dict], entry: str = "entry_date") -> DataFrame:
    """One row per fold a trade takes part in, with its ``role``. The folds are literals, not a join."""
    entries = ", ".join(
        f"struct('{f['fold']}' AS fold, DATE'{f['train_from']}' AS a, DATE'{f['train_to']}' AS b, DATE'{f['test_from']}' AS c, DATE'{f['test_to']}' AS d)"
        for f in folds
    )
    inside = f"{entry} BETWEEN x.a AND x.b OR {entry} BETWEEN x.c AND x.d"
    rows = df.selectExpr("*", f"explode(filter(array({entries}), x -> {inside})) AS _f")
    return rows.selectExpr(
        *df.columns, "_f.fold AS fold", f"CASE WHEN {entry} BETWEEN _f.a AND _f.b THEN 'train' ELSE 'test' END AS role", "_f.c AS test_from"
    )


def purge_embargo(assigned: DataFrame, embargo: int = 5, entry: str = "entry_date", exit_: str = "exit_date") -> DataFrame:
    """Drop training rows whose exit reaches the test window or that enter on the last ``embargo``
    training sessions of the fold."""
    days = assigned.filter("role = 'train'").select("fold", entry).distinct()
    late = days.selectExpr("fold", entry, f"row_number() OVER (PARTITION BY fold ORDER BY {entry} DESC) AS _k").filter(f"_k <= {embargo}")
    late = late.selectExpr("fold", entry, "'train' AS role")
    kept = assigned.filter(f"role = 'test' OR {exit_} < test_from")
    return kept.join(late, ["fold", "role", entry], "left_anti")


def ndcg(df: DataFrame, score: str, label: str, ks=(3, 5, 10), by: str = "entry_date") -> DataFrame:
    """Mean daily NDCG at each k, over sessions with at least two rows and some gain."""
    rows = df.selectExpr(by, f"{label} AS _l", f"round({score}, 12) AS _s", "code")
    gain = "(pow(2D, _l) - 1)"
    daily = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2")
    # Only the first rows of each order count, so sessions are cut to them before they move.
    for name, order in (("_d", "_s DESC, code"), ("_m", "_l DESC, code")):
        first = top_n(rows, max(ks), by, order, "_r")
        daily = daily.join(first.groupBy(by).agg(*[F.expr(f"sum(CASE WHEN _r <= {k} THEN {gain} / log2(_r + 1) ELSE 0D END)").alias(f"{name}{k}") for k in ks]), by)
    return daily.agg(*[F.expr(f"coalesce(avg(CASE WHEN _m{k} > 0 THEN _d{k} / _m{k} END), 0D)").alias(f"ndcg_at_{k}") for k in ks])


def hold_days_residual(df: DataFrame, bins: int = 4, least: int = 20) -> DataFrame:
    """Return minus a straight-line fit on holding days inside each quantile bin of holding days."""
    names = {f"e{i}": i / bins for i in range(1, bins)}
    edges = exact_quantiles(df, [], "hold_days", names).select(F.array_distinct(F.array(*names))).scalar()
    rows = df.withColumn("_e", edges).selectExpr(*df.columns, "size(filter(_e, x -> hold_days >= x)) AS hold_bin")
    fit = rows.groupBy("hold_bin").agg(
        F.count(F.lit(1)).alias("_n"),
        F.expr("try_divide(covar_pop(hold_days, return_pct), var_pop(hold_days))").alias("_s"),
        F.avg("return_pct").alias("_my"),
        F.avg("hold_days").alias("_mx"),
    ).selectExpr("hold_bin", f"CASE WHEN _n >= {least} THEN coalesce(_s, 0D) ELSE 0D END AS _s", "_my", "_mx")
    return rows.join(F.broadcast(fit), "hold_bin").selectExpr(
        *df.columns, "hold_bin", "return_pct - (_my + _s * (hold_days - _mx)) AS residual"
    )


def residualizer_check(residuals: DataFrame) -> DataFrame:
    """t of the mean residual, Levene statistic across bins (deviations from the bin median), and
    the share of return variance left per bin fit."""
    med = exact_quantiles(residuals, ["hold_bin"], "residual", {"_med": 0.5})
    rows = residuals.join(F.broadcast(med), "hold_bin").selectExpr("*", "abs(residual - _med) AS _z")
    g = rows.groupBy("hold_bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_z").alias("mz"), F.var_pop("_z").alias("vz"))
    total = residuals.agg(
        F.expr("avg(residual) / (stddev_samp(residual) / sqrt(count(1)))").alias("t"),
        F.expr("1 - var_pop(residual) / var_pop(return_pct)").alias("r2"),
    ).select(F.struct("t", "r2")).scalar()
    lev = g.agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.expr("sum(n * mz) / sum(n)").alias("grand"),
        F.expr("sum(n * mz * mz)").alias("q"),
        F.expr("sum(n * vz)").alias("within"),
    ).withColumn("_t", total)
    return lev.selectExpr(
        "n", "k AS bins", "_t.t AS mean_t", "try_divide((n - k) * (q - n * grand * grand), (k - 1) * within) AS levene", "_t.r2 AS r2"
    )


def ratio_residual(df: DataFrame, y: str, x: str, train: str, out: str, least: int = 100) -> DataFrame:
    """Residual of ``y`` on ``x`` fitted on the training rows."""
    fit = df.filter(train).filter(f"{y} IS NOT NULL AND {x} IS NOT NULL").agg(
        F.expr(
            f"struct(CASE WHEN count(1) >= {least} THEN coalesce(try_divide(covar_pop({y}, {x}), var_pop({x})), 0D) ELSE 0D END AS s, "
            f"avg({y}) AS my, avg({x}) AS mx)"
        )
    ).scalar()
    return df.withColumn("_f", fit).selectExpr(
        *df.columns, f"{y} - (_f.my + _f.s * ({x} - CASE WHEN _f.s = 0 THEN {x} ELSE _f.mx END)) AS {out}"
    )


def placebo(df: DataFrame, features: Sequence[str], seed: int, by: str = "date") -> DataFrame:
    """Permute the features among the rows of a session, by a seeded hash of the row key. Codes of one length are placed by blocks of them, so a session is not one window."""
    drawn = df.selectExpr("*", f"md5(concat_ws('|', code, '{seed}')) AS _h")
    base = with_positions(df, [by], "substr(code, 1, length(code) - 2)", "code").drop("size").withColumnRenamed("pos", "_k")
    donor = with_positions(drawn, [by], "substr(_h, 1, 2)", "_h, code").selectExpr(by, *[f"{f} AS _p_{f}" for f in features], "pos AS _k")
    keep = [c for c in df.columns if c not in features]
    return base.join(donor, [by, "_k"]).selectExpr(*keep, *[f"_p_{f} AS {f}" for f in features])


def robust_scale(df: DataFrame, features: Sequence[str], train: str) -> DataFrame:
    """(x - median) / interquartile range of the training rows."""
    entries = ", ".join(f"struct('{f}' AS factor, CAST({f} AS DOUBLE) AS x)" for f in features)
    long = df.filter(train).selectExpr(f"explode(array({entries})) AS e").selectExpr("e.factor AS factor", "e.x AS x")
    q = exact_quantiles(long, ["factor"], "x", {"a": 0.25, "m": 0.5, "b": 0.75})
    table = q.agg(F.expr("map_from_entries(collect_list(struct(factor, struct(m, b - a AS iqr))))")).scalar()
    return df.withColumn("_q", table).selectExpr(
        *[c for c in df.columns if c not in features],
        *[f"({f} - _q['{f}'].m) / CASE WHEN _q['{f}'].iqr > 0 THEN _q['{f}'].iqr ELSE 1D END AS {f}" for f in features],
    )


def rank_model(train: DataFrame, features: Sequence[str], label: str, rounds: int = 20, depth: int = 4, weight: str | None = None):
    """Gradient-boosted trees on the label; returns the fitted pipeline, which scores as a column.

    A missing feature takes the training median, so every row gets a score; rows without a label do not train.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    filled = [f"_filled_{f}" for f in features]
    imputer = Imputer(inputCols=list(features), outputCols=filled, strategy="median")
    assembler = VectorAssembler(inputCols=filled, outputCol="_x")
    trees = GBTRegressor(featuresCol="_x", labelCol=label, predictionCol="score", maxIter=rounds, maxDepth=depth, seed=7)
    if weight:
        trees = trees.setWeightCol(weight)
    return Pipeline(stages=[imputer, assembler, trees]).fit(train.where(F.col(label).isNotNull()))


def hold_decay_weight(df: DataFrame, rate: float) -> DataFrame:
    return df.selectExpr("*", f"exp(-{rate}D * hold_days) AS sample_weight")


def parameter_grid(df: DataFrame, grid: Sequence[dict], condition: str) -> DataFrame:
    """Trade metrics of many parameter sets in one pass over the signals.

    ``condition`` refers to the parameters as ``p.<name>``; each row is copied only to the sets it
    passes.
    """
    from tapeloom.operators.outcomes import trade_metrics

    entries = ", ".join("struct(" + ", ".join(f"{v!r} AS {k}" for k, v in g.items()) + ")" for g in grid)
    rows = df.selectExpr("*", f"explode(filter(array({entries}), p -> {condition})) AS p")
    return trade_metrics(rows.selectExpr("*", "p.id AS param_id"), ["param_id"])


def fold_deltas(baseline: DataFrame, candidate: DataFrame, metric: str, window: str = "fold") -> DataFrame:
    """Candidate minus baseline per window, reduced to wins, worst and mean."""
    both = baseline.selectExpr(window, f"{metric} AS b").join(candidate.selectExpr(window, f"{metric} AS c"), window)
    return both.selectExpr("c - b AS d").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(F.col("d") > 0).alias("wins"), F.min("d").alias("worst"), F.avg("d").alias("mean_delta")
    )


def coverage_report(df: DataFrame, features: Sequence[str], digits: int | None = None) -> DataFrame:
    """Non-null rows, coverage, distinct values and spread of each feature, in one scan. With ``digits``, values that agree
    in so many digits count as one."""
    value = "x" if digits is None else F.round("x", digits)
    entries = ", ".join(f"struct('{f}' AS feature, CAST({f} AS DOUBLE) AS x)" for f in features)
    long = df.selectExpr(f"explode(array({entries})) AS e").selectExpr("e.feature AS feature", "e.x AS x")
    return long.groupBy("feature").agg(
        F.count("x").alias("non_null"),
        (F.count("x") * 100 / F.count(F.lit(1))).alias("coverage_pct"),
        F.count_distinct(value).alias("distinct_values"),
        F.stddev_samp("x").alias("std"),
    )


def prescreen(df: DataFrame, features: Sequence[str], label: str, train: str, by: str = "date", min_coverage: float = 80.0) -> DataFrame:
    """Coverage, variation and direction of each feature on the training rows, with a verdict."""
    rows = df.filter(train)
    cover = coverage_report(rows, features).withColumnRenamed("feature", "factor")
    assoc = pooled_spearman(rows, features, label)
    return cover.join(assoc.select("factor", "spearman"), "factor", "left").selectExpr(
        "*", f"coverage_pct >= {min_coverage} AND std > 1e-12 AND abs(spearman) > 0.01 AS passed", "sign(spearman) AS orientation"
    )


def preflight_cells(df: DataFrame, factor: str, label: str, states: DataFrame, state: str, by: str = "date", cells: int = 1) -> DataFrame:
    """Daily IC by tertile of the market state: means, high minus low, Welch t, and the bar at which
    one of ``cells`` tests stays significant."""
    ic = daily_rank_ic(df, factor, label, by).join(states.select(by, state), by)
    cuts = ic.agg(F.percentile(state, F.array(F.lit(1 / 3), F.lit(2 / 3)))).scalar()
    ic = ic.withColumn("_c", cuts).selectExpr("*", f"CASE WHEN {state} <= _c[0] THEN 'low' WHEN {state} <= _c[1] THEN 'mid' ELSE 'high' END AS bucket")
    agg = ic.filter(f"{state} IS NOT NULL").agg(
        *[F.expr(f"{fn}(CASE WHEN bucket = '{b}' THEN rank_ic END)").alias(f"{b}_{n}")
          for b in ("low", "mid", "high") for fn, n in (("count", "n"), ("avg", "mean"), ("var_samp", "var"))]
    )
    return agg.selectExpr(
        f"'{factor}' AS factor", "low_n", "mid_n", "high_n", "low_mean", "mid_mean", "high_mean", "high_mean - low_mean AS delta",
        "try_divide(high_mean - low_mean, sqrt(high_var / high_n + low_var / low_n)) AS welch_t",
        f"0.05D / {cells} AS bonferroni_level",
    )


def regime_delta(baseline: DataFrame, candidate: DataFrame, n: int = 3, by: str = "entry_date") -> DataFrame:
    """Mean return of each side's best ``n`` per session, by regime, and the difference."""

    def side(df: DataFrame, name: str) -> DataFrame:
        ranked = df.selectExpr("regime_label", "return_pct", f"row_number() OVER (PARTITION BY {by} ORDER BY round(score, 12) DESC, code) AS _r")
        return ranked.filter(f"_r <= {n}").groupBy("regime_label").agg(F.avg("return_pct").alias(name))

    return side(baseline, "baseline").join(side(candidate, "candidate"), "regime_label").selectExpr("*", "candidate - baseline AS delta")
