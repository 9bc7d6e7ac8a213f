"""Bar quality: audits, validation reasons, source comparison, and repairs that keep a log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import windows as w
from tapeloom.operators.joins import near_rows

# Provider markers for a missing number.
MISSING_SENTINELS = (2147483647.0, 2147483648.0, 4294967295.0)


def audit_bars(bars: DataFrame, limit: float = 0.25) -> DataFrame:
    """Stored against computed return and amplitude; rows without both sides are not eligible."""
    out = bars.selectExpr("*", f"{w.ref('close')} AS pc").selectExpr(
        "*",
        "CASE WHEN pc > 0 THEN (close / pc - 1) * 100 END AS calc_change_pct",
        "CASE WHEN pc > 0 THEN (high - low) / pc * 100 END AS calc_amplitude",
    )
    return out.selectExpr(
        *bars.columns,
        "calc_change_pct",
        "calc_amplitude",
        "calc_change_pct IS NOT NULL AND change_pct IS NOT NULL AS return_eligible",
        "calc_amplitude IS NOT NULL AND amplitude IS NOT NULL AS amplitude_eligible",
        "abs(calc_change_pct - change_pct) AS return_error",
        "abs(calc_amplitude - amplitude) AS amplitude_error",
    ).selectExpr(
        "*",
        f"coalesce(return_error > {limit}, false) AS return_bad",
        f"coalesce(amplitude_error > {limit}, false) AS amplitude_bad",
    )


def cross_section_spike(audited: DataFrame, ratio: float = 0.20, least: int = 100) -> DataFrame:
    """Per date: eligible and bad rows, their ratio, and whether the date must be quarantined."""
    sums = [
        F.count_if(f"{k}_{s}").alias(f"{k}_{s}") for k in ("return", "amplitude") for s in ("eligible", "bad")
    ]
    out = audited.groupBy("date").agg(*sums)
    out = out.selectExpr(
        "*", *[f"coalesce(try_divide({k}_bad, {k}_eligible), 0D) AS {k}_bad_ratio" for k in ("return", "amplitude")]
    )
    spike = [f"{k}_eligible >= {least} AND {k}_bad_ratio >= {ratio}" for k in ("return", "amplitude")]
    return out.selectExpr("*", f"{spike[0]} AS return_spike", f"{spike[1]} AS amplitude_spike", f"({spike[0]}) OR ({spike[1]}) AS quarantine")


def issue_rows(audited: DataFrame) -> DataFrame:
    """One row per mismatch: kind, stored and computed value, error."""
    return audited.selectExpr(
        "code",
        "date",
        "stack(2, 'return', return_bad, change_pct, calc_change_pct, return_error, "
        "'amplitude', amplitude_bad, amplitude, calc_amplitude, amplitude_error) AS (kind, bad, stored, computed, error)",
    ).filter("bad").drop("bad")


def field_quality(bars: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per field: finite, valid, missing on traded and suspended rows, zero and negative counts."""
    entries = ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in fields)
    long = bars.selectExpr("volume > 0 AS traded", f"stack({len(fields)}, {entries}) AS (field, x)")
    return long.groupBy("field").agg(
        F.count("x").alias("finite"),
        F.expr("count_if(x > 0)").alias("valid"),
        F.expr("count_if(x IS NULL AND traded)").alias("missing_traded"),
        F.expr("count_if(x IS NULL AND NOT coalesce(traded, false))").alias("missing_suspended"),
        F.expr("count_if(x = 0)").alias("zero"),
        F.expr("count_if(x < 0)").alias("negative"),
    )


def completed_bars(bars: DataFrame) -> DataFrame:
    """Rows with every field positive and high and low enclosing the body."""
    return bars.filter(
        "open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume > 0 AND amount > 0 "
        "AND high >= greatest(open, close) AND low <= least(open, close)"
    )


def compare_sources(left: DataFrame, right: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Per year: dates on one side only, both valid, equal closes, and right amounts that could fill."""
    cols = ("close", "volume", "amount")
    a = left.selectExpr("code", "date", *[f"{c} AS l_{c}" for c in cols], "true AS in_l")
    b = right.selectExpr("code", "date", *[f"{c} AS r_{c}" for c in cols], "true AS in_r")
    both = a.join(b, ["code", "date"], "full_outer")
    usable = "r_amount > 0 AND l_volume > 0 AND abs(r_volume / l_volume - 1) <= 0.01"
    return both.groupBy(F.year("date").alias("year")).agg(
        F.expr("count_if(in_r IS NULL)").alias("only_left"),
        F.expr("count_if(in_l IS NULL AND r_volume > 0)").alias("only_right_traded"),
        F.expr("count_if(in_l IS NULL AND NOT r_volume > 0)").alias("only_right_idle"),
        F.expr("count_if(in_l AND in_r)").alias("shared"),
        F.expr(f"count_if(abs(l_close / r_close - 1) <= {tol})").alias("equal_close"),
        F.expr("count_if(l_amount > 0 AND r_amount > 0)").alias("both_amount"),
        F.expr(f"count_if(in_l AND l_amount IS NULL AND {usable})").alias("amount_candidates"),
    )


def identify_gaps(bars: DataFrame, other: DataFrame) -> DataFrame:
    """Dates the other source traded and this one lacks, and rows without a usable amount."""
    missing = other.filter("volume > 0").join(bars, ["code", "date"], "left_anti").selectExpr("code", "date", "'bar' AS gap")
    amounts = bars.filter("volume > 0 AND (amount IS NULL OR amount <= 0)").selectExpr("code", "date", "'amount' AS gap")
    return missing.unionByName(amounts)


def gap_top_dates(gaps: DataFrame, n: int = 20) -> DataFrame:
    return gaps.groupBy("date", "gap").agg(F.count(F.lit(1)).alias("codes")).orderBy(F.desc("codes"), "date", "gap").limit(n)


def first_reason(*rules: tuple[str, str]) -> str:
    """The name of the first rule that holds, or null."""
    return "CASE " + " ".join(f"WHEN {cond} THEN '{name}'" for name, cond in rules) + " END"


def validate_raw_bar(bars: DataFrame, tol: float = 0.01) -> DataFrame:
    """Reason a raw bar is refused: fields, envelope, vwap, turnover or cap."""
    fields = ("open", "high", "low", "close", "volume", "amount")
    vwap = "(amount / volume)"
    return bars.selectExpr(
        "*",
        first_reason(
            ("missing_field", " OR ".join(f"NOT coalesce({f} > 0, false)" for f in fields)),
            ("low_above_high", "low > high"),
            ("body_below_low", f"least(open, close) < low * {1 - tol}D"),
            ("body_above_high", f"greatest(open, close) > high * {1 + tol}D"),
            ("vwap_outside", f"NOT {vwap} BETWEEN low * {1 - tol}D AND high * {1 + tol}D"),
            ("invalid_turnover", "NOT coalesce(turnover > 0 AND turnover <= 1000, false)"),
            ("cap_mismatch", "market_cap IS NOT NULL AND abs(market_cap / (close * volume * 100 / turnover) - 1) > 0.01"),
        )
        + " AS reason",
    )


def validate_history(bars: DataFrame, min_amount: float = 0.8, min_cap: float = 0.9) -> DataFrame:
    """Per instrument: coverages and the first rule of the history that fails; null means valid."""
    prices = ("open", "high", "low", "close", "close_raw")
    bad_price = " OR ".join(f"NOT coalesce({p} > 0, false)" for p in prices)
    bad_order = "high + 1e-9D < greatest(open, close) OR low - 1e-9D > least(open, close) OR high + 1e-9D < low"
    sentinel = "amount IN (" + ", ".join(f"{x}D" for x in MISSING_SENTINELS) + ")"
    ratio = "amount / volume / close_raw"
    rows = bars.selectExpr("*", f"{w.ROW_INDEX} AS _k")
    g = rows.groupBy("code").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("date").alias("_dates"),
        F.min("date").alias("date_start"),
        F.max("date").alias("date_end"),
        F.expr(f"count_if({bad_price})").alias("_price"),
        F.expr(f"count_if({bad_order})").alias("_order"),
        F.expr("count_if(NOT coalesce(volume >= 0, false))").alias("_volume"),
        F.expr(f"count_if({sentinel})").alias("_sentinel"),
        F.expr("count_if(volume > 0)").alias("_pos"),
        F.expr("count_if(volume > 0 AND amount > 0)").alias("_amt"),
        F.expr(
            f"count_if(volume > 0 AND amount > 0 AND close_raw > 0 AND NOT {ratio} BETWEEN 0.5 AND 2 AND NOT (_k <= 5 AND {ratio} BETWEEN 0.2 AND 2))"
        ).alias("_trade"),
        F.expr("count_if(volume > 0 AND close_raw > 0 AND turnover > 0 AND market_cap IS NOT NULL)").alias("_cap"),
        F.expr("max(CASE WHEN volume > 0 AND turnover > 0 AND close_raw > 0 THEN abs(market_cap / (close_raw * volume * 100 / turnover) - 1) END)").alias("formula_error"),
    )
    g = g.selectExpr("*", "_amt / greatest(_pos, 1) AS amount_coverage", "_cap / greatest(_pos, 1) AS cap_coverage")
    reason = first_reason(
        ("duplicate_dates", "rows > _dates"),
        ("invalid_price", "_price > 0"),
        ("invalid_order", "_order > 0"),
        ("invalid_volume", "_volume > 0"),
        ("amount_sentinel", "_sentinel > 0"),
        ("amount_coverage", f"amount_coverage < {min_amount}"),
        ("trade_value_mismatch", "_trade > 0"),
        ("cap_coverage", f"cap_coverage < {min_cap}"),
        ("cap_formula", "formula_error > 1e-9D"),
    )
    return g.selectExpr("code", "rows", "date_start", "date_end", "amount_coverage", "cap_coverage", f"{reason} AS reason")


def derive_change_fields(bars: DataFrame) -> DataFrame:
    """Change, change percent and amplitude from the previous close."""
    keep = [c for c in bars.columns if c not in ("change", "change_pct", "amplitude")]
    return bars.selectExpr("*", f"{w.ref('close')} AS _pc").selectExpr(
        *keep, "close - _pc AS change", "(close / _pc - 1) * 100 AS change_pct", "(high - low) / _pc * 100 AS amplitude"
    )


def turnover_and_cap(bars: DataFrame) -> DataFrame:
    """Turnover and cap from outstanding shares; without them, shares follow from the turnover given."""
    keep = [c for c in bars.columns if c not in ("turnover", "market_cap")]
    return bars.selectExpr(
        "*", "coalesce(nullif(shares, 0D), CASE WHEN turnover > 0 AND volume > 0 THEN volume * 100 / turnover END) AS _sh"
    ).selectExpr(*keep, "CASE WHEN shares > 0 THEN volume * 100 / shares ELSE turnover END AS turnover", "close_raw * _sh AS market_cap")


def repair_envelope(bars: DataFrame, limit: float = 0.01) -> DataFrame:
    """Clamp high and low to the body where the gap is at most ``limit``; ``repaired`` logs the rows."""
    need_high, need_low = "greatest(open, high, low, close)", "least(open, high, low, close)"
    gap = f"greatest({need_high} - high, low - {need_low}) / {need_high}"
    ok = f"open > 0 AND high > 0 AND low > 0 AND close > 0 AND {gap} > 0 AND {gap} <= {limit}"
    keep = [c for c in bars.columns if c not in ("high", "low")]
    return bars.selectExpr(
        *keep,
        "high AS old_high",
        "low AS old_low",
        f"CASE WHEN {ok} THEN {need_high} ELSE high END AS high",
        f"CASE WHEN {ok} THEN {need_low} ELSE low END AS low",
        f"coalesce({ok}, false) AS repaired",
    )


def flat_bar_amount(bars: DataFrame) -> DataFrame:
    """Amount of a bar whose four prices are equal and whose amount is missing."""
    flat = "open = high AND high = low AND low = close AND volume > 0 AND amount IS NULL"
    keep = [c for c in bars.columns if c != "amount"]
    return bars.selectExpr(*keep, f"CASE WHEN {flat} THEN close_raw * volume ELSE amount END AS amount", f"({flat}) AS filled")


def fill_amount(bars: DataFrame, legacy: DataFrame, tol: float = 0.01) -> DataFrame:
    """Take the legacy amount where the volumes agree and its vwap lies in the raw range."""
    src = legacy.selectExpr("code", "date", "volume AS _v", "amount AS _a")
    ok = f"amount IS NULL AND _a > 0 AND abs(_v / volume - 1) <= {tol} AND _a / volume BETWEEN low * {1 - tol}D AND high * {1 + tol}D"
    keep = [c for c in bars.columns if c != "amount"]
    return bars.join(src, ["code", "date"], "left").selectExpr(
        *keep, f"CASE WHEN {ok} THEN _a ELSE amount END AS amount", f"coalesce({ok}, false) AS filled"
    )


def valid_valuation(x: str) -> str:
    """Finite, non-zero and not a provider marker."""
    marks = ", ".join(f"{m}D" for m in MISSING_SENTINELS)
    return f"coalesce(NOT isnan({x}) AND abs({x}) < 1e15D AND {x} <> 0 AND {x} NOT IN ({marks}), false)"


def fill_valuation(bars: DataFrame, sources: Sequence[DataFrame], field: str, cutoff: str) -> DataFrame:
    """First valid value of ``field`` among the sources, in order, up to the cutoff date; no carry."""
    out = bars
    for i, s in enumerate(sources):
        out = out.join(s.selectExpr("code", "date", f"{field} AS _s{i}"), ["code", "date"], "left")
    options = ", ".join(f"CASE WHEN {valid_valuation(f'_s{i}')} THEN _s{i} END" for i in range(len(sources)))
    keep = [c for c in bars.columns if c != field]
    value = f"CASE WHEN {valid_valuation(field)} THEN {field} WHEN date <= DATE'{cutoff}' THEN coalesce({options}) END"
    return out.selectExpr(*keep, f"{value} AS {field}")


def fill_day(bars: DataFrame, remote: DataFrame, field: str, day: str) -> DataFrame:
    """``field`` of one day from a remote quote, where the local value is not valid and the remote one is; ``filled`` says where.

    Of several remote rows of a code the one of the greatest ``seq`` counts, valid or not.
    """
    last = remote.filter(f"date = DATE'{day}'").groupBy("code").agg(F.max_by(field, "seq").alias("_v"))
    fill = f"date = DATE'{day}' AND NOT {valid_valuation(field)} AND {valid_valuation('_v')}"
    keep = [c for c in bars.columns if c != field]
    return bars.join(last, "code", "left").selectExpr(*keep, f"CASE WHEN {fill} THEN _v ELSE {field} END AS {field}", f"{fill} AS filled")


def overlay(base: DataFrame, replacement: DataFrame, key: str = "code") -> DataFrame:
    """``base`` with every file (all rows of a key) that ``replacement`` holds taken from there; ``replaced`` says which."""
    from_base = base.join(replacement.select(key).distinct(), key, "left_anti").withColumn("replaced", F.lit(False))
    known = base.select(key).distinct()
    return from_base.unionByName(replacement.join(known, key, "left_semi").select(base.columns).withColumn("replaced", F.lit(True)))


def stable_adjustment_factor(bars: DataFrame, n: int = 5, tol: float = 0.001) -> DataFrame:
    """Median of close/close_raw before and after each row, and the factor where both agree."""
    ratio = "CASE WHEN close > 0 AND close_raw > 0 THEN close / close_raw END"
    out = bars.selectExpr("*", f"{ratio} AS _r")
    before = f"collect_list(_r) {w.rows(n, 1)}"
    after = f"collect_list(_r) OVER (PARTITION BY code ORDER BY date DESC ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    out = out.selectExpr("*", f"sort_array({before}) AS _b", f"sort_array({after}) AS _a").selectExpr(
        "*", "sort_array(concat(_b, _a)) AS _all"
    )

    def med(a: str) -> str:
        return f"(get({a}, CAST(floor((size({a}) - 1) / 2) AS INT)) + get({a}, CAST(ceil((size({a}) - 1) / 2) AS INT))) / 2"

    out = out.selectExpr(
        *bars.columns,
        f"CASE WHEN size(_b) > 0 THEN {med('_b')} END AS before_factor",
        f"CASE WHEN size(_a) > 0 THEN {med('_a')} END AS after_factor",
        f"CASE WHEN size(_all) > 0 THEN {med('_all')} END AS _f",
    )
    gap = "abs(before_factor / after_factor - 1)"
    return out.selectExpr(
        "* EXCEPT (_f)",
        first_reason(("missing_anchor", "before_factor IS NULL OR after_factor IS NULL"), ("anchor_mismatch", f"{gap} > {tol}")) + " AS reason",
        f"CASE WHEN {gap} <= {tol} THEN _f END AS factor",
    )


def insert_bars(bars: DataFrame, other: DataFrame) -> DataFrame:
    """Add bars missing here from the other source, scaled by the factor of the latest earlier row."""
    missing = other.filter("volume > 0").join(bars, ["code", "date"], "left_anti")
    cols = ["open", "high", "low", "close"]
    base = bars.selectExpr("code", "date", *cols, "close_raw", "volume", "amount", "close / close_raw AS _f", "false AS inserted")
    new = missing.selectExpr("code", "date", *cols, "close_raw", "volume", "amount", "CAST(NULL AS DOUBLE) AS _f", "true AS inserted")
    both = base.unionByName(new).selectExpr("*", f"last(_f, true) {w.SO_FAR} AS _use")
    return both.filter("NOT inserted OR _use IS NOT NULL").selectExpr(
        "code", "date", *[f"CASE WHEN inserted THEN {c} * _use ELSE {c} END AS {c}" for c in cols], "close_raw", "volume", "amount", "inserted"
    )


def affine_transform(local: DataFrame, remote: DataFrame, points: int = 60, least: int = 3, max_error: float = 0.0025) -> DataFrame:
    """Per instrument, local = slope * remote + intercept over the latest shared closes.

    Fit once, keep the points within the 90% quantile of the relative error, fit again, and accept by
    the largest error over all points. At most ``points`` rows per instrument are used.
    """
    pairs = local.filter("volume > 0 AND close > 0").selectExpr("code", "date", "close AS y").join(
        remote.filter("close > 0").selectExpr("code", "date", "close AS x"), ["code", "date"]
    )
    pairs = pairs.selectExpr("*", "row_number() OVER (PARTITION BY code ORDER BY date DESC) AS _k").filter(f"_k <= {points}")
    g = w.group("code")

    def fit(df: DataFrame, keep: str, s: str, b: str) -> DataFrame:
        x, y = f"CASE WHEN {keep} THEN x END", f"CASE WHEN {keep} THEN y END"
        df = df.selectExpr("*", f"try_divide(covar_pop({x}, {y}) {g}, var_pop({x}) {g}) AS {s}")
        return df.selectExpr("*", f"avg({y}) {g} - {s} * avg({x}) {g} AS {b}")

    first = fit(pairs, "true", "_s1", "_b1").selectExpr("*", "abs((_s1 * x + _b1) / y - 1) AS _e1", f"count(1) {g} AS _n")
    first = first.selectExpr("*", f"round(_e1, 12) <= round(percentile(_e1, 0.9) {g}, 12) AS _in").selectExpr("*", f"_n < 10 OR _in AS _use")
    second = fit(first, "_use", "_s", "_b").selectExpr("*", "abs((_s * x + _b) / y - 1) AS _e")
    agg = second.groupBy("code").agg(
        F.max("_n").alias("anchor_points"),
        F.max("_s").alias("slope"),
        F.max("_b").alias("intercept"),
        F.max("_e").alias("max_error"),
        F.percentile("_e", F.lit(0.95)).alias("p95_error"),
        F.expr("(max(x) - min(x)) / greatest(abs(percentile(x, 0.5)), 1e-12D)").alias("variation"),
    )
    status = first_reason(
        ("insufficient_overlap", f"anchor_points < {least}"),
        ("insufficient_variation", "variation < 0.005"),
        ("invalid_slope", "NOT coalesce(slope > 0, false)"),
        ("unstable", f"max_error > {max_error}"),
    )
    return agg.selectExpr("*", f"coalesce({status}, 'stable') AS status")


def rebuild_segment(local: DataFrame, remote: DataFrame, fits: DataFrame, start: str, end: str) -> DataFrame:
    """Replace prices of a date range by transformed remote prices, recompute changes, mark changes."""
    cols = ("open", "high", "low", "close")
    stable = fits.filter("status = 'stable'").select("code", "slope", "intercept")
    src = remote.join(stable, "code").filter(f"date BETWEEN DATE'{start}' AND DATE'{end}'")
    src = src.selectExpr("code", "date", *[f"slope * {c} + intercept AS _{c}" for c in cols])
    out = local.join(src, ["code", "date"], "left").selectExpr(
        *[c for c in local.columns if c not in cols],
        *[f"coalesce(_{c}, {c}) AS {c}" for c in cols],
        "coalesce(abs(_close / close - 1) > 1e-9D, false) AS rebuilt",
    )
    return derive_change_fields(out)


def rebase_scale(local: DataFrame, remote: DataFrame, limit: float = 0.01) -> DataFrame:
    """Median ratio of shared closes for the adjusted and the raw price; the steadier one wins."""
    pairs = local.selectExpr("code", "date", "close AS la", "close_raw AS lr").join(
        remote.selectExpr("code", "date", "close AS x"), ["code", "date"]
    )
    long = pairs.selectExpr("code", "stack(2, 'adjusted', la / x, 'raw', lr / x) AS (kind, ratio)")
    per = long.groupBy("code", "kind").agg(
        F.count("ratio").alias("anchors"),
        F.percentile("ratio", F.lit(0.5)).alias("scale"),
        F.expr("(percentile(ratio, 0.9) - percentile(ratio, 0.1)) / percentile(ratio, 0.5)").alias("dispersion"),
    )
    best = per.groupBy("code").agg(F.expr("min_by(struct(kind, anchors, scale, dispersion), struct(round(dispersion, 12), kind))").alias("b"))
    return best.selectExpr("code", "b.*", f"b.dispersion <= {limit} AS accepted")


def scale_sandwich(bars: DataFrame, jump: float = 0.3, match: float = 0.1) -> DataFrame:
    """Rows whose price scale differs from both neighbours while the neighbours agree."""
    prev, nxt = w.ref("close"), w.lead("close")
    return bars.selectExpr("*", f"{prev} AS _p", f"{nxt} AS _n").selectExpr(
        *bars.columns,
        "close / _p AS scale_in",
        f"coalesce(abs(_n / _p - 1) <= {match} AND abs(close / _p - 1) > {jump} AND abs(close / _n - 1) > {jump}, false) AS sandwiched",
    )


def provenance(repaired: DataFrame, snapshots: DataFrame, tol: float = 1e-6) -> DataFrame:
    """How the prices of a repaired row match the named snapshots of the same bar."""
    cols = ("open", "high", "low", "close")
    near = [f"abs(r.{c} - s.{c}) <= {tol} * abs(r.{c})" for c in cols]
    joined = repaired.alias("r").join(snapshots.alias("s"), ["code", "date"], "left").selectExpr(
        "code", "date", "s.source AS source", f"coalesce({' AND '.join(near)}, false) AS full", f"coalesce({near[3]}, false) AS close_only"
    )
    agg = joined.groupBy("code", "date").agg(
        F.expr("sort_array(collect_set(CASE WHEN full THEN source END))").alias("sources"), F.max("close_only").alias("_c")
    )
    return agg.selectExpr(
        "code",
        "date",
        "concat_ws(',', sources) AS matched_sources",
        "CASE WHEN size(sources) > 1 THEN 'multiple_full' WHEN size(sources) = 1 THEN 'unique_full' WHEN _c THEN 'close_only' ELSE 'none' END AS provenance",
    )


def apply_corrections(bars: DataFrame, corrections: DataFrame, field: str = "close") -> DataFrame:
    """Set the new value where the old one is as expected; deletions likewise. Others are reported."""
    c = corrections.selectExpr("code", "date", "expected", "corrected", "action")
    hit = f"abs({field} - expected) <= 1e-9D * abs(expected)"
    out = bars.join(c, ["code", "date"], "left").selectExpr(
        *bars.columns, "corrected", f"CASE WHEN action IS NULL THEN 'untouched' WHEN {hit} THEN action ELSE 'conflict' END AS result"
    )
    keep = [x for x in bars.columns if x != field]
    return out.filter("result <> 'delete'").selectExpr(*keep, f"CASE WHEN result = 'replace' THEN corrected ELSE {field} END AS {field}", "result")


def recompute_neighbours(bars: DataFrame, changed: str = "changed") -> DataFrame:
    """Refresh the change fields of changed rows and of the row after each, and nothing else."""
    fields = ("change", "change_pct", "amplitude")
    out = bars.selectExpr("*", f"coalesce({changed} OR {w.ref(changed)}, false) AS touched", f"{w.ref('close')} AS _pc")
    new = {"change": "close - _pc", "change_pct": "(close / _pc - 1) * 100", "amplitude": "(high - low) / _pc * 100"}
    return out.selectExpr(
        *[c for c in bars.columns if c not in fields], "touched", *[f"CASE WHEN touched THEN {new[f]} ELSE {f} END AS {f}" for f in fields]
    )


def adjust_quotes(quotes: DataFrame, bars: DataFrame, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """Bring opening quotes to the local price scale by local close over quoted last close."""
    last = bars.groupBy("code").agg(F.max_by("close", "date").alias("local_close"))
    return quotes.join(last, "code").selectExpr("*", "try_divide(local_close, last_close) AS factor").selectExpr(
        "*", "open * factor AS adjusted_open", f"NOT coalesce(factor BETWEEN {low} AND {high}, false) AS out_of_range"
    )


def open_quote_gate(quotes: DataFrame, valid_share: float = 0.8, moved_share: float = 0.3) -> DataFrame:
    """Whether enough opens are valid and enough differ from the last close."""
    return quotes.agg(
        F.expr("avg(CASE WHEN open > 0 THEN 1D ELSE 0D END)").alias("valid_share"),
        F.expr("avg(CASE WHEN open > 0 AND abs(open / last_close - 1) > 1e-9D THEN 1D ELSE 0D END)").alias("moved_share"),
    ).selectExpr("*", f"valid_share >= {valid_share} AND moved_share >= {moved_share} AS passed")


def bar_availability(expected: DataFrame, bars: DataFrame, confirmed: DataFrame, failed: DataFrame) -> DataFrame:
    """present, confirmed_absent, failed or unknown; a bar that is also confirmed absent is a conflict."""
    key = ["code", "date"]
    out = expected.join(bars.select(*key).withColumn("_b", F.lit(1)), key, "left")
    out = out.join(confirmed.select(*key).withColumn("_c", F.lit(1)), key, "left")
    out = out.join(failed.select(*key).withColumn("_f", F.lit(1)), key, "left")
    state = (
        "CASE WHEN _b = 1 AND _c = 1 THEN 'conflict' WHEN _b = 1 THEN 'present' WHEN _c = 1 THEN 'confirmed_absent' "
        "WHEN _f = 1 THEN 'failed' ELSE 'unknown' END"
    )
    return out.selectExpr(*key, f"{state} AS availability")


def nearby_duplicates(bars: DataFrame, reach: int = 7, tol: float = 1e-3) -> DataFrame:
    """Rows with another row of the instrument within ``reach`` days and the same close and volume."""
    # The dates of an instrument differ, so the frame holds at most 2 * reach + 1 rows.
    frame = f"OVER (PARTITION BY code ORDER BY unix_date(date) RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)"
    near = bars.selectExpr("code", "date", "close", "volume", f"collect_list(struct(date, close, volume)) {frame} AS _near")
    same = f"o -> o.date <> date AND abs(o.close / close - 1) <= {tol} AND abs(o.volume / volume - 1) <= {tol}"
    return near.selectExpr("code", "date", f"explode(filter(_near, {same})) AS _o").selectExpr("code", "date", "_o.date AS other_date")


def match_events(changes: DataFrame, events: DataFrame, reach: int = 5, tol: float = 0.03) -> DataFrame:
    """Best event within ``reach`` rows whose ratio agrees within ``tol``: least error, then distance."""
    pairs = near_rows(changes, events.selectExpr("code AS code", "rn AS event_rn", "ratio AS event_ratio"), "code", "rn", "event_rn", reach)
    ok = pairs.selectExpr("*", "abs(ratio / event_ratio - 1) AS error", "abs(event_rn - rn) AS distance").filter(f"error <= {tol}")
    return ok.groupBy("code", "rn").agg(
        F.expr("min_by(struct(event_rn, error, distance), struct(round(error, 12), distance, event_rn))").alias("m")
    ).select("code", "rn", "m.*")


def backward_adjust(raw: DataFrame, actions: DataFrame) -> DataFrame:
    """Multiply prices by the running product of action factors.

    An action counts from the first bar on or after its date. Its factor is
    ``prev_close * (1 + shares) / (prev_close - cash + rights * price)``; without a usable previous
    close, ``1 + shares``. Factors of one bar combine before the running product.
    """
    acts = actions.selectExpr(
        "code", "date AS adate", "bonus_ratio + rights_ratio AS cap", "cash_per_share AS cash", "rights_ratio * rights_price AS paid"
    )
    rows = raw.selectExpr("code", "date", "close", f"{w.ref('close')} AS _pc")
    both = rows.selectExpr("code", "date AS t", "1 AS k", "date AS bar", "_pc", "CAST(NULL AS DOUBLE) AS cap", "CAST(NULL AS DOUBLE) AS cash", "CAST(NULL AS DOUBLE) AS paid").unionByName(
        acts.selectExpr("code", "adate AS t", "0 AS k", "CAST(NULL AS DATE) AS bar", "CAST(NULL AS DOUBLE) AS _pc", "cap", "cash", "paid")
    )
    frame = "OVER (PARTITION BY code ORDER BY t DESC, k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    placed = both.selectExpr("*", f"last(CASE WHEN k = 1 THEN struct(bar, _pc) END, true) {frame} AS _at")
    factor = "CASE WHEN _at._pc > 0 AND _at._pc - cash + paid > 0 THEN _at._pc * (1 + cap) / (_at._pc - cash + paid) ELSE 1 + cap END"
    per_bar = placed.filter("k = 0 AND _at IS NOT NULL").groupBy("code", F.col("_at.bar").alias("date")).agg(F.expr(f"sum(ln({factor}))").alias("_lf"))
    out = raw.join(per_bar, ["code", "date"], "left").selectExpr("*", f"exp(sum(coalesce(_lf, 0D)) {w.SO_FAR}) AS adjust_factor")
    cols = ("open", "high", "low", "close")
    return out.selectExpr(*[c for c in raw.columns if c not in cols], *[f"{c} * adjust_factor AS {c}" for c in cols], "adjust_factor")


def action_chain_affine(actions: DataFrame) -> DataFrame:
    """Compose per-action steps: slope is the running product of multipliers, and each additive part
    is scaled by the slope before it."""
    run = w.running("code")
    prior = w.running("code", skip=1)
    out = actions.selectExpr("*", f"exp(sum(ln(multiplier)) {run}) AS slope", f"coalesce(exp(sum(ln(multiplier)) {prior}), 1D) AS _before")
    return out.selectExpr("code", "date", "slope", f"sum(_before * additive) {run} AS intercept")


# Unit errors looked for, and the evidence a regime needs.
UNIT_CANDIDATES = (2.0, 2.5, 4.0, 5.0, 10.0, 20.0, 25.0, 40.0, 50.0, 100.0, 500.0)
REGIME_ROWS = 20
REGIME_SHARE = 0.8
MISSING_SENTINELS = (2147483647.0, 2147483648.0, 4294967295.0)


def repair_trade_units(bars: DataFrame, candidates: Sequence[float] = UNIT_CANDIDATES, least: int = REGIME_ROWS, share: float = REGIME_SHARE) -> DataFrame:
    """Repair persistent volume-unit regimes, then isolated tenfold errors, and null what is left.

    Sentinels count as missing, and so does an amount that is not positive beside a volume; a missing volume has no amount. A row is suspect when amount/volume leaves the raw range by 2%. Multipliers are tried per
    instrument in order of the suspect rows they explain; each pass sees the rows taken before. A
    regime is the span between the first and last explained row that no normal or otherwise
    explained row interrupts.
    """
    multipliers = list(dict.fromkeys([*candidates, *[1 / c for c in candidates]]))
    keep = list(bars.columns)
    sentinels = ", ".join(f"{x!r}D" for x in MISSING_SENTINELS)
    lost = f"coalesce(volume IN ({sentinels}), false)"
    void = f"{lost} OR coalesce(amount IN ({sentinels}), false) OR coalesce(volume > 0 AND amount <= 0, false)"
    others = [c for c in keep if c not in ("volume", "amount")]
    bars = bars.selectExpr(*others, f"CASE WHEN NOT {lost} THEN volume END AS volume", f"CASE WHEN NOT ({void}) THEN amount END AS amount").select(*keep)
    vwap = "(amount / volume)"
    known = "volume > 0 AND amount > 0 AND low_raw > 0 AND high_raw >= low_raw"

    def bad(v: str = "volume") -> str:
        return f"coalesce({known} AND NOT amount / {v} BETWEEN low_raw * 0.98D AND high_raw * 1.02D, false)"

    out = bars.selectExpr("*", f"{bad()} AS _bad", f"coalesce({known}, false) AS _known", f"{vwap} AS _w", "false AS _taken", "volume AS _vol")
    out = out.selectExpr(
        "*", *[f"_bad AND _w / {m!r}D BETWEEN low_raw * 0.98D AND high_raw * 1.02D AS _c{i}" for i, m in enumerate(multipliers)]
    )
    counts = ", ".join(f"struct(count_if(_c{i}) {w.group('code')} AS n, {-i} AS k)" for i in range(len(multipliers)))
    out = out.selectExpr("*", f"transform(sort_array(array({counts}), false), x -> -x.k) AS _order")
    which = "CASE " + " ".join(f"WHEN _order[{{p}}] = {i} THEN _c{i}" for i in range(len(multipliers))) + " END"
    scale = "CASE " + " ".join(f"WHEN _order[{{p}}] = {i} THEN {m!r}D" for i, m in enumerate(multipliers)) + " END"
    cols = [c for c in out.columns if c not in ("_taken", "_vol")]
    for p in range(len(multipliers)):
        mine = which.format(p=p)
        step = out.selectExpr("*", f"({mine}) AND NOT _taken AS _ev", f"_taken OR (_known AND NOT _bad) OR (_bad AND NOT ({mine})) AS _wall")
        step = step.selectExpr("*", f"count_if(_wall) {w.SO_FAR} AS _seg")
        g = w.group("code", "_seg")
        step = step.selectExpr(
            "*", f"count_if(_ev) {g} AS _n", f"min(CASE WHEN _ev THEN date END) {g} AS _a", f"max(CASE WHEN _ev THEN date END) {g} AS _z"
        )
        step = step.selectExpr("*", "date BETWEEN _a AND _z AND NOT _taken AS _inside")
        step = step.selectExpr("*", f"count_if(_bad AND _inside) {g} AS _m", f"count_if(_ev) {w.group('code')} AS _all")
        take = f"coalesce(_inside AND volume > 0 AND _all >= {least} AND _n >= {least} AND _m > 0 AND _n / _m >= {share}, false)"
        out = step.selectExpr(*cols, f"_taken OR {take} AS _taken", f"CASE WHEN {take} THEN _vol * {scale.format(p=p)} ELSE _vol END AS _vol")
    up, down = [f"(amount / _vol / {m} BETWEEN low_raw AND high_raw)" for m in ("10D", "0.1D")]
    still = bad("_vol")
    out = out.selectExpr("*", f"CASE WHEN {still} AND {up} AND NOT {down} THEN 10D WHEN {still} AND {down} AND NOT {up} THEN 0.1D END AS _iso")
    out = out.selectExpr("*", "_vol * coalesce(_iso, 1D) AS _final")
    return out.selectExpr(
        *[c for c in keep if c not in ("volume", "amount")],
        "_final AS volume",
        f"CASE WHEN {bad('_final')} THEN NULL ELSE amount END AS amount",
        "CASE WHEN _taken THEN 'regime' WHEN _iso IS NOT NULL THEN 'isolated' ELSE 'none' END AS unit_repair",
    )


def repair_committed_units(bars: DataFrame, reference: DataFrame | None = None, candidates: Sequence[float] = UNIT_CANDIDATES, least: int = REGIME_ROWS, share: float = REGIME_SHARE) -> DataFrame:
    """Repair the units of committed bars and what follows from them.

    ``bars`` hold (code, date, low, high, close, close_raw, volume, amount, turnover, market_cap); raw prices are the adjusted ones over their factor. A
    positive amount of ``reference`` (code, date, amount) counts before the committed one, and passes the same tests. A volume that changes brings a
    new turnover, from the shares of the market cap, or where there is none from those of the old turnover, and then the market cap too. An amount that
    is refused is null, one that was missing is filled, and one with a reference is replaced if it differs. ``repair`` lists what happened.
    """
    rows = bars.selectExpr("*", "try_divide(close, close_raw) AS _f")
    if reference is not None:
        rows = rows.join(reference.filter("amount > 0").selectExpr("code", "date", "amount AS _ref"), ["code", "date"], "left")
    else:
        rows = rows.withColumn("_ref", F.lit(None).cast("double"))
    work = rows.selectExpr(
        "code", "date", "try_divide(low, _f) AS low_raw", "try_divide(high, _f) AS high_raw", "close_raw", "volume", "coalesce(_ref, amount) AS amount",
        "volume AS _volume", "amount AS _amount", "low", "high", "close", "turnover", "market_cap", "_ref",
    )
    fixed = repair_trade_units(work, candidates, least, share)
    changed = "coalesce(abs(_volume - volume) > 1e-9D + 1e-12D * abs(volume), false)"
    replaced = "coalesce(_ref IS NOT NULL AND abs(_amount - amount) > 0.01D + 1e-7D * abs(amount), false)"
    by_cap = "try_divide(market_cap, close_raw)"
    fixed = fixed.selectExpr(
        "*", f"{changed} AS _changed", "_amount IS NOT NULL AND amount IS NULL AS _cleared", "_amount IS NULL AND amount IS NOT NULL AS _filled", f"{replaced} AS _replaced",
        f"CASE WHEN {by_cap} > 0 THEN {by_cap} ELSE try_divide(_volume * 100, turnover) END AS _shares",
    ).selectExpr("*", "coalesce(_changed AND _shares > 0, false) AS _again")
    fixed = fixed.selectExpr("*", "_again AND NOT coalesce(market_cap > 0, false) AND coalesce(close_raw > 0, false) AS _cap")
    done = {"volume": "_changed", "amount_cleared": "_cleared", "amount_filled": "_filled", "amount_replaced": "_replaced", "turnover": "_again", "market_cap": "_cap"}
    new = {
        "volume": "CASE WHEN _changed THEN volume ELSE _volume END",
        "amount": "CASE WHEN _cleared THEN NULL WHEN _filled OR _replaced THEN amount ELSE _amount END",
        "turnover": "CASE WHEN _again THEN volume * 100 / _shares ELSE turnover END",
        "market_cap": "CASE WHEN _cap THEN close_raw * _shares ELSE market_cap END",
    }
    listed = "array_join(filter(array(" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in done.items()) + "), x -> x IS NOT NULL), ',')"
    return fixed.selectExpr(*[f"{new[c]} AS {c}" if c in new else c for c in bars.columns], f"{listed} AS repair")
