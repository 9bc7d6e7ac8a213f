"""Trade labels, position returns, costs and net-value metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions import windows as w
from tapeloom.functions.quantiles import exact_quantiles
from tapeloom.operators.joins import asof_join, explode_days

RISK_FREE = 0.02
SESSIONS_PER_YEAR = 252.0


def label_trades(df: DataFrame, placeholders: bool = False) -> DataFrame:
    """Label every ``brick_signal`` row: next open in, first falling brick's close out.

    An open at the upper limit blocks the entry; one-word limit-down sessions cannot be sold and are
    skipped. ``status`` is closed, open or blocked; values that do not exist are null, or with
    ``placeholders`` the signal close, the signal date, zero return and zero days.
    """
    out = df.selectExpr(
        "*",
        f"brick < {w.ref('brick')} AS _falling",
        f"min(CASE WHEN NOT one_word_down THEN struct(rn, date, close) END) {w.ahead()} AS _sell",
        f"{w.lead('open')} AS _open",
        f"{w.lead('date')} AS _date",
        f"coalesce(NOT {w.lead('open_limit_up')}, false) AS _in",
    )
    out = out.selectExpr("*", f"min(CASE WHEN _falling THEN _sell END) {w.ahead(1)} AS _exit").filter("brick_signal")
    done = "CASE WHEN _in AND _exit IS NOT NULL THEN"
    out = out.selectExpr(
        *[c for c in df.columns if c != "date"],
        "date AS signal_date",
        f"{done} 'closed' WHEN _in THEN 'open' ELSE 'blocked' END AS status",
        "CASE WHEN _in THEN _date END AS entry_date",
        "CASE WHEN _in THEN _open END AS entry_price",
        f"{done} _exit.date END AS exit_date",
        f"{done} _exit.close END AS exit_price",
        f"{done} (_exit.close - _open) / _open * 100 END AS return_pct",
        f"{done} _exit.rn - rn - 1 END AS hold_days",
    )
    if placeholders:
        out = (
            out.withColumn("entry_date", F.coalesce("entry_date", "signal_date"))
            .withColumn("entry_price", F.coalesce("entry_price", "close"))
            .withColumn("exit_date", F.coalesce("exit_date", "signal_date"))
            .withColumn("exit_price", F.coalesce("exit_price", "close"))
            .withColumn("return_pct", F.coalesce("return_pct", F.lit(0.0)))
            .withColumn("hold_days", F.coalesce("hold_days", F.lit(0)))
        )
    return out


def business_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    )
    return days.filter(F.weekday("day") < 5)


def trade_calendar(trades: DataFrame) -> DataFrame:
    """Weekdays from the first entry to the last exit."""
    span = trades.agg(F.min("entry_date").alias("a"), F.max("exit_date").alias("b"))
    return explode_days(span, "a", "b").select("day")


def position_returns(trades: DataFrame, bars: DataFrame, carry_marks: bool = True) -> DataFrame:
    """One row per trade and held weekday with that day's return.

    Entry day: close against entry price. Exit day: exit price against the previous close. Both on
    one day: exit against entry. Otherwise close against the previous session's close. With
    ``carry_marks`` a day without a bar is marked at the last close (return 0); without it such a
    day has no return.
    """
    held = explode_days(trades, "entry_date", "exit_date")
    marks = bars.selectExpr("code", "date", "close AS mark", f"{w.ref('close')} AS mark_prev")
    held = asof_join(
        held.select("code", "entry_date", "exit_date", "entry_price", "exit_price", "day"),
        marks,
        "code",
        "day",
        "date",
        ["mark", "mark_prev"],
    )
    today = F.col("asof_time") == F.col("day")
    prev = F.when(today, F.col("mark_prev")).otherwise(F.col("mark"))
    cur = F.col("mark") if carry_marks else F.when(today, F.col("mark"))
    enters, leaves = F.col("day") == F.col("entry_date"), F.col("day") == F.col("exit_date")
    ret = (
        F.when(enters & leaves, F.col("exit_price") / F.col("entry_price") - 1)
        .when(enters, cur / F.col("entry_price") - 1)
        .when(leaves, F.col("exit_price") / prev - 1)
        .otherwise(cur / prev - 1)
    )
    return held.withColumn("ret", ret)


def daily_returns(
    trades: DataFrame,
    bars: DataFrame,
    commission_bp: float = 2.5,
    stamp_pct: float = 0.05,
    slippage_pct: float = 0.1,
    spread_over: int | None = None,
    carry_marks: bool = True,
) -> DataFrame:
    """Mean return of active positions per weekday, net of costs, with the active count.

    Costs of a day's entries and exits are divided by ``spread_over`` when given, otherwise by the
    number of active positions.
    """
    per_day = (
        position_returns(trades, bars, carry_marks)
        .groupBy("day")
        .agg(F.avg("ret").alias("gross"), F.count(F.lit(1)).alias("active"))
    )
    cost_in = commission_bp / 10000.0 + slippage_pct / 100.0
    cost_out = cost_in + stamp_pct / 100.0
    events = (
        trades.select(F.col("entry_date").alias("day"), F.lit(cost_in).alias("cost"))
        .unionByName(trades.select(F.col("exit_date").alias("day"), F.lit(cost_out).alias("cost")))
        .groupBy("day")
        .agg(F.sum("cost").alias("cost"))
    )
    share = F.lit(float(spread_over)) if spread_over else F.greatest(F.coalesce("active", F.lit(0)), F.lit(1))
    return (
        trade_calendar(trades)
        .join(per_day, "day", "left")
        .join(events, "day", "left")
        .select(
            "day",
            F.coalesce("active", F.lit(0)).alias("active"),
            (F.coalesce("gross", F.lit(0.0)) - F.coalesce("cost", F.lit(0.0)) / share).alias("ret"),
        )
    )


def add_nav(daily: DataFrame, by: str | None = None) -> DataFrame:
    """Net value and drawdown. One row per day, so the ordered window is bounded by the calendar."""
    spec = Window.partitionBy(*([by] if by else [])).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumn("nav", F.product(1 + F.col("ret")).over(spec))
    return out.withColumn("drawdown", F.col("nav") / F.max("nav").over(spec) - 1)


def nav_metrics(daily: DataFrame, by: str | None = None) -> DataFrame:
    """Cumulative and annual return, drawdown, Sharpe, Calmar and daily win rate."""
    nav = add_nav(daily, by)
    agg = nav.groupBy(*([by] if by else [])).agg(
        F.count(F.lit(1)).alias("days"),
        F.max_by("nav", "day").alias("_last"),
        F.min("drawdown").alias("_dd"),
        F.stddev_samp("ret").alias("_sd"),
        (F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)) * 100).alias("daily_win_pct"),
        (F.avg("ret") * 100).alias("daily_avg_pct"),
    )
    annual = F.when(F.col("_last") > 0, F.pow("_last", SESSIONS_PER_YEAR / F.col("days")) - 1).otherwise(F.lit(-1.0))
    agg = agg.withColumn("_ann", annual).withColumn("_vol", F.col("_sd") * F.sqrt(F.lit(SESSIONS_PER_YEAR)))
    return agg.select(
        *([by] if by else []),
        "days",
        ((F.col("_last") - 1) * 100).alias("cum_return_pct"),
        (F.col("_ann") * 100).alias("cagr_pct"),
        (F.col("_dd") * 100).alias("max_drawdown_pct"),
        F.when(F.col("_vol") > 0, (F.col("_ann") - RISK_FREE) / F.col("_vol")).otherwise(F.lit(0.0)).alias("sharpe"),
        F.when(F.col("_dd") < 0, F.col("_ann") / F.abs("_dd")).otherwise(F.lit(0.0)).alias("calmar"),
        "daily_win_pct",
        "daily_avg_pct",
    )


def stitch_nav(daily: DataFrame, fold: str = "fold") -> DataFrame:
    """Join the out-of-sample returns of consecutive folds; a day in two folds counts once, first fold."""
    first = daily.groupBy("day").agg(F.min_by("ret", fold).alias("ret"), F.min_by("active", fold).alias("active"))
    return add_nav(first)


def trade_metrics(trades: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, win rate and return statistics by group; the median comes from value counts, so a group may be any size."""
    ret, by = F.col("return_pct"), list(by or [])
    median = exact_quantiles(trades, by, "return_pct", {"median_return_pct": 0.5})
    stats = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_distinct("entry_date").alias("entry_days"),
        (F.avg(F.when(ret > 0, 1.0).otherwise(0.0)) * 100).alias("win_rate_pct"),
        F.avg(ret).alias("avg_return_pct"),
        F.coalesce(F.stddev_samp(ret), F.lit(0.0)).alias("std_return_pct"),
        F.avg("hold_days").alias("avg_hold_days"),
    )
    return stats.join(median, by, "left") if by else stats.withColumn("median_return_pct", median.select("median_return_pct").scalar())


def monthly_stats(trades: DataFrame) -> DataFrame:
    return trades.groupBy(F.date_trunc("month", "entry_date").cast("date").alias("month")).agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(F.when(F.col("return_pct") > 0, 1.0).otherwise(0.0)) * 100).alias("win_rate_pct"),
        F.avg("return_pct").alias("avg_return_pct"),
    )


def drawdown_and_monthly_sharpe(daily: DataFrame) -> DataFrame:
    """Largest drawdown, and the Sharpe ratio of month-end returns scaled by sqrt(12)."""
    month = F.date_trunc("month", "day").alias("month")
    months = add_nav(daily).groupBy(month).agg(F.max_by("nav", "day").alias("nav"), F.min("drawdown").alias("dd"))
    step = F.col("nav") / F.lag("nav").over(Window.orderBy("month")) - 1
    out = months.withColumn("ret", step).agg(
        F.count("ret").alias("months"),
        (F.min("dd") * 100).alias("max_drawdown_pct"),
        ((F.max_by("nav", "month") - 1) * 100).alias("total_return_pct"),
        F.avg("ret").alias("_m"),
        F.stddev_samp("ret").alias("_s"),
    )
    sharpe = F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * F.sqrt(F.lit(12.0))).otherwise(F.lit(0.0))
    return out.select("months", "max_drawdown_pct", "total_return_pct", sharpe.alias("monthly_sharpe"))


def stale_valuation(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Value of each instrument on each calendar date: its close, or the last known one marked stale.

    Dates before an instrument's first bar give no row.
    """
    life = bars.groupBy("code").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    # One array of calendar dates, read as a scalar: its size is the length of the calendar.
    days = calendar.agg(F.sort_array(F.collect_set("date"))).scalar()
    grid = life.withColumn("_days", days).select(
        "code", F.explode(F.filter("_days", lambda x: x >= F.col("_a"))).alias("date")
    )
    full = grid.join(bars.select("code", "date", "close"), ["code", "date"], "left")
    return full.selectExpr("code", "date", f"last(close, true) {w.SO_FAR} AS value", "close IS NULL AS stale")


def distribution_exit(paths: DataFrame, gain: float = 0.04, prev_ratio: float = 1.5, ma20_ratio: float = 2.0, bull_ratio: float = 0.9, upper: float = 0.7) -> DataFrame:
    """Add ``s1``: some bar since the entry is a heavy bearish bar, as seen on the row's own session.

    ``paths`` holds the rows of each trade (code, entry_rn) from its entry row on, with the volume before as ``volume_before``. Such
    a bar falls with aligned averages on heavy volume (against the bar before, the mean of up to twenty bars since the entry, or the
    largest rising bar so far), high in the range of the last twenty bars or within three bars of one of the three highest.
    Nothing counts before the best close is ``gain`` above the entry's.
    """
    by = "PARTITION BY code, entry_rn ORDER BY rn ROWS BETWEEN"
    so_far, past = f"OVER ({by} UNBOUNDED PRECEDING AND CURRENT ROW)", f"OVER ({by} 20 PRECEDING AND 1 PRECEDING)"
    last = f"OVER ({by} 19 PRECEDING AND CURRENT ROW)"
    heavy = f"coalesce(volume / volume_before >= {prev_ratio}D, false) OR coalesce(volume / avg(volume) {past} >= {ma20_ratio}D, false)"
    bearish = "coalesce(ma5 > ma10 AND ma10 > ma20 AND close <= open AND low < high, false)"
    rows = paths.selectExpr("*", f"{heavy} AS _heavy", f"{bearish} AS _bearish").selectExpr(
        "*",
        f"collect_list(CASE WHEN _bearish THEN struct(rn, close, volume, _heavy AS heavy) END) {so_far} AS _bars",
        f"max(CASE WHEN close > open THEN volume END) {so_far} AS _bull",
        f"slice(reverse(sort_array(collect_list(struct(high, -rn AS at)) {so_far})), 1, 3) AS _top",
        f"max(high) {last} AS _high",
        f"min(low) {last} AS _low",
        f"max(close) {so_far} / first(close) {so_far} - 1 AS _best",
    )
    volume = f"(b.heavy OR coalesce(_bull > 0 AND b.volume >= _bull * {bull_ratio}D, false))"
    place = f"((_high > _low AND (b.close - _low) / (_high - _low) >= {upper}D) OR exists(_top, t -> b.rn + t.at BETWEEN 1 AND 3))"
    return rows.selectExpr(*paths.columns, f"rn > entry_rn AND _best >= {gain}D AND exists(_bars, b -> {volume} AND {place}) AS s1")


def trade_paths(trades: DataFrame, bars: DataFrame, rows: int) -> DataFrame:
    """Each trade's entry bar and the ``rows`` bars after it."""
    shown = bars.selectExpr(
        *"code rn date open high low close volume ma5 ma10 ma20 white_line yellow_line".split(), "lag(volume) OVER (PARTITION BY code ORDER BY rn) AS volume_before"
    )
    return trades.withColumn("rn", F.explode(F.sequence("entry_rn", F.col("entry_rn") + rows))).join(shown, ["code", "rn"])


def exit_rules(
    trades: DataFrame,
    bars: DataFrame,
    weak_days: int = 3,
    weak_return: float = 0.02,
    max_hold_days: int = 60,
    target: float = 0.25,
    launch_gain: float = 0.05,
) -> DataFrame:
    """First exit event of each trade and the rule that caused it.

    On one session the rules apply in this order: stop, weak after ``weak_days``, break of yellow,
    break of white after launch, profit target after launch, distribution (S1), longest hold. ``trades`` carries the
    entry row number ``entry_rn`` and ``stop_price``; sessions are reached by an equi-join on
    (code, row number). Sessions have different dates, so the longest hold ends within as many rows as it has days.
    """
    paths = distribution_exit(trade_paths(trades, bars, max_hold_days)).filter("rn > entry_rn")
    gain = F.col("close") / F.col("entry_price") - 1
    days = F.datediff("date", "entry_date")
    path = Window.partitionBy("code", "entry_rn").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    launched = F.max((gain > launch_gain) & (F.col("close") > F.col("white_line"))).over(path)
    paths = paths.withColumn("launched", launched)
    rules = (
        ("stop_loss", F.col("low") <= F.col("stop_price"), F.col("stop_price")),
        ("weak", (days >= weak_days) & (gain < weak_return), F.col("close")),
        ("break_yellow", F.col("close") < F.col("yellow_line"), F.col("close")),
        ("break_white", F.col("launched") & (F.col("close") < F.col("white_line")), F.col("close")),
        ("target", F.col("launched") & (gain > target), F.col("close")),
        ("S1", F.col("s1"), F.col("close")),
        ("max_hold", days >= max_hold_days, F.col("close")),
    )
    event = F.coalesce(
        *[F.when(cond, F.struct("rn", F.lit(name).alias("reason"), "date", price.alias("price"))) for name, cond, price in rules]
    )
    # ``launched`` never turns back, so the event's own row has it for the whole path; an open trade has its last row's.
    event = F.when(event.isNotNull(), F.struct(event.alias("e"), "launched"))
    first = paths.withColumn("event", event).groupBy("code", "entry_rn").agg(
        F.first("entry_date").alias("entry_date"),
        F.first("entry_price").alias("entry_price"),
        F.min("event").alias("exit"),
        F.max("launched").alias("launched"),
    )
    first = first.withColumn("event", F.col("exit.e")).withColumn("launched_in_path", F.coalesce("exit.launched", "launched"))
    return first.select(
        "code",
        "entry_date",
        "entry_price",
        "launched_in_path",
        F.col("event.reason").alias("exit_reason"),
        F.col("event.date").alias("exit_date"),
        F.col("event.price").alias("exit_price"),
        ((F.col("event.price") / F.col("entry_price") - 1) * 100).alias("profit_pct"),
    )


def strategy_metrics(trades: DataFrame) -> DataFrame:
    """Win and loss statistics of closed trades, with each trade's profit as its return."""
    win = F.col("return_pct") > 0
    ret = F.col("return_pct")
    top = trades.orderBy(ret.desc(), "code", "entry_date").limit(10).agg(F.sum(ret)).scalar()
    agg = trades.agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if(win).alias("winning_trades"),
        F.count_if(~win).alias("losing_trades"),
        F.avg(F.when(win, ret)).alias("avg_win"),
        F.avg(F.when(~win, ret)).alias("avg_loss"),
        F.sum(F.when(win, ret)).alias("_gp"),
        F.sum(F.when(~win, ret)).alias("_gl"),
        F.sum(ret).alias("_sum"),
        F.avg(F.when(win, F.col("hold_days"))).alias("avg_hold_win"),
        F.avg(F.when(~win, F.col("hold_days"))).alias("avg_hold_loss"),
        F.max_by("code", F.struct(ret, "code")).alias("best_code"),
        F.max(ret).alias("best_pct"),
        F.min_by("code", F.struct(ret, "code")).alias("worst_code"),
        F.min(ret).alias("worst_pct"),
    )
    return agg.withColumn("_top10", top).select(
        "total_trades",
        "winning_trades",
        "losing_trades",
        (F.col("winning_trades") / F.col("total_trades") * 100).alias("win_rate"),
        F.coalesce("avg_win", F.lit(0.0)).alias("avg_win"),
        F.coalesce("avg_loss", F.lit(0.0)).alias("avg_loss"),
        F.expr("coalesce(abs(try_divide(avg_win, avg_loss)), 99D)").alias("wl_ratio"),
        F.expr("coalesce(abs(try_divide(_gp, _gl)), 99D)").alias("profit_factor"),
        "avg_hold_win",
        "avg_hold_loss",
        "best_code",
        "best_pct",
        "worst_code",
        "worst_pct",
        F.when(F.col("_sum") != 0, F.col("_top10") / F.col("_sum") * 100).otherwise(F.lit(0.0)).alias("top10_share_pct"),
    )


def composite_score(metrics: DataFrame) -> DataFrame:
    """Weighted composite of strategy metrics; 0 below 30 trades."""
    m = F.col
    # The weights, scales and caps of the composite.
    score = (
        m("total_return_pct") * 0.25
        + m("monthly_sharpe") * 60 * 0.18
        + F.least(m("profit_factor"), F.lit(5.0)) * 12 * 0.15
        + (100 - F.abs("max_drawdown_pct")) * 0.08
        + F.least(m("win_rate"), F.lit(55.0)) * 0.15
        + F.least(m("total_trades"), F.lit(300)) * 0.07
        + F.least(m("wl_ratio"), F.lit(5.0)) * 4 * 0.07
        + F.least(60 - F.abs(m("top10_share_pct") - 90), F.lit(40.0)) * 0.05
    )
    return metrics.withColumn("score", F.when(m("total_trades") >= 30, score).otherwise(F.lit(0.0)))


def compare_to_target(metrics: DataFrame, targets: dict[str, float], lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    """One row per metric: current value, target, improvement and WIN or LOSE."""
    long = metrics.unpivot([], list(targets), "metric", "current")
    target = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))])
    lower = F.col("metric").isin(*lower_is_better) if lower_is_better else F.lit(False)
    out = long.withColumn("target", F.element_at(target, F.col("metric")))
    out = out.withColumn("current", F.when(lower, F.abs("current")).otherwise(F.col("current")))
    delta = F.when(lower, F.col("target") - F.col("current")).otherwise(F.col("current") - F.col("target"))
    out = out.withColumn("delta", delta).withColumn("status", F.when(delta > 0, "WIN").otherwise("LOSE"))
    share = F.count_if(F.col("status") == "WIN").over(Window.partitionBy(F.lit(1))) / F.lit(float(len(targets)))
    return out.withColumn("win_share", share)
