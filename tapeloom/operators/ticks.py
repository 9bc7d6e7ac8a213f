"""Tick microstructure: size classes, big orders, order flow, intensity, phases, features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.positions import sliding, with_positions
from tapeloom.functions.quantiles import exact_quantiles

# Upper limits of the size classes, and the institutional amount.
SIZE_LIMITS = {"retail": 20000, "small": 100000, "medium": 500000, "large": 1000000}
INSTITUTIONAL_MIN = 100000
# Session phases; both ends belong to a phase.
PHASES = {
    "opening_call": ("09:15", "09:25"),
    "early": ("09:30", "10:30"),
    "mid_morning": ("10:30", "11:30"),
    "early_after": ("13:00", "14:00"),
    "late": ("14:00", "14:55"),
    "closing": ("14:55", "15:00"),
}

DAY = ("code", "date")
MINUTE = "date_trunc('minute', time)"
ORDER = "time, seq"
SIGNED = "CASE direction WHEN 1 THEN volume WHEN -1 THEN -volume ELSE 0D END"
BUY = "CASE WHEN direction = 1 THEN volume ELSE 0D END"
SELL = "CASE WHEN direction = -1 THEN volume ELSE 0D END"


def classify_size(df: DataFrame, limits: dict[str, float] = SIZE_LIMITS) -> DataFrame:
    """Add ``order_class`` by amount; above the last limit is huge."""
    cases = " ".join(f"WHEN amount < {v} THEN '{k}'" for k, v in limits.items())
    return df.selectExpr("*", f"CASE {cases} ELSE 'huge' END AS order_class")


def flag_big_orders(
    df: DataFrame, keys: Sequence[str] = DAY, big: float = 0.85, huge: float = 0.97, least: int = 10, fixed: float = INSTITUTIONAL_MIN
) -> DataFrame:
    """Flag amounts at or above the group's quantiles, or fixed limits for groups up to ``least``."""
    limits = exact_quantiles(df, keys, "amount", {"q_big": big, "q_huge": huge})
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    limits = limits.join(sizes, list(keys)).selectExpr(
        *keys,
        f"CASE WHEN _n > {least} THEN q_big ELSE {fixed}D END AS big_limit",
        f"CASE WHEN _n > {least} THEN q_huge ELSE {fixed * 5}D END AS huge_limit",
    )
    return df.join(limits, list(keys)).selectExpr(
        "*", "amount >= big_limit AS is_big_order", "amount >= huge_limit AS is_huge_order"
    )


def _pct(part: str, whole: str) -> str:
    return f"coalesce(try_divide({part}, {whole}) * 100, 0D)"


def big_order_stats(flagged: DataFrame, keys: Sequence[str] = DAY) -> DataFrame:
    return flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if("is_big_order").alias("big_order_count"),
        F.count_if("is_huge_order").alias("huge_order_count"),
        F.expr("count_if(is_big_order AND direction = 1)").alias("_buy"),
    ).selectExpr(
        *keys,
        "big_order_count",
        f"{_pct('big_order_count', '_n')} AS big_order_pct",
        f"{_pct('_buy', 'big_order_count')} AS big_order_buy_ratio",
        "huge_order_count",
        f"{_pct('huge_order_count', '_n')} AS huge_order_pct",
    )


def trader_flow(df: DataFrame, keys: Sequence[str] = DAY, institutional: float = INSTITUTIONAL_MIN) -> DataFrame:
    """Buy, sell and net volume of institutional and retail prints."""
    inst = f"amount >= {institutional}"
    sums = {
        f"{who}_{side}_vol": f"sum(CASE WHEN {cond} AND direction = {d} THEN volume ELSE 0D END)"
        for who, cond in (("institutional", inst), ("retail", f"NOT ({inst})"))
        for side, d in (("buy", 1), ("sell", -1))
    }
    out = df.groupBy(*keys).agg(*[F.expr(e).alias(c) for c, e in sums.items()])
    return out.selectExpr(
        "*",
        "institutional_buy_vol - institutional_sell_vol AS institutional_net_flow",
        "retail_buy_vol - retail_sell_vol AS retail_net_flow",
    )


def order_flow(df: DataFrame, keys: Sequence[str] = DAY, block: str = MINUTE, width: int = 50) -> DataFrame:
    """Position, running signed volume ``cum_delta`` and imbalance ``ofi`` of the last ``width`` prints."""
    placed = with_positions(df, keys, block, ORDER, {"cum_delta": SIGNED})
    out = sliding(placed, keys, width, {"_b": f"sum({BUY})", "_s": f"sum({SELL})"})
    return out.selectExpr(*placed.columns, "(_b - _s) / (_b + _s + 1e-8D) AS ofi")


def tick_intensity(df: DataFrame, keys: Sequence[str] = DAY, width: str = "minute", fill: bool = True) -> DataFrame:
    """Prints per ``width``; with ``fill``, empty slots between the first and the last count 0."""
    counts = df.groupBy(*keys, F.date_trunc(width, "time").alias("slot")).agg(F.count("price").alias("ticks"))
    if not fill:
        return counts
    slots = counts.groupBy(*keys).agg(F.min("slot").alias("_a"), F.max("slot").alias("_z"))
    slots = slots.selectExpr(*keys, f"explode(sequence(_a, _z, INTERVAL 1 {width.upper()})) AS slot")
    return slots.join(counts, [*keys, "slot"], "left").selectExpr(*keys, "slot", "coalesce(ticks, 0) AS ticks")


def tick_surge(df: DataFrame, keys: Sequence[str] = DAY, width: str = "minute", sigmas: float = 3.0, least: int = 100) -> DataFrame:
    """Slots whose count exceeds the mean by ``sigmas`` sample deviations.

    Empty slots enter through their number alone, so they are never materialised.
    """
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[width]
    counts = tick_intensity(df, keys, width, fill=False)
    stats = counts.groupBy(*keys).agg(
        F.sum("ticks").alias("_t"),
        F.sum(F.col("ticks") * F.col("ticks")).alias("_q"),
        ((F.unix_timestamp(F.max("slot")) - F.unix_timestamp(F.min("slot"))) / seconds + 1).alias("_n"),
    )
    stats = stats.filter(f"_t >= {least} AND _n > 1").selectExpr(
        *keys, "_t / _n AS _mean", "sqrt(greatest((_q - _t * _t / _n) / (_n - 1), 0D)) AS _sd"
    )
    return counts.join(stats, list(keys)).filter(f"_sd > 0 AND ticks > _mean + {sigmas} * _sd").selectExpr(
        *keys, "slot", "ticks", "ticks / _mean AS multiplier"
    )


def session_phases(df: DataFrame, keys: Sequence[str] = DAY, phases: dict[str, tuple[str, str]] = PHASES) -> DataFrame:
    """Count, volume, amount and buy share of each phase; a print on a shared edge is in both."""
    clock = "date_format(time, 'HH:mm')"
    aggs = []
    for p, (a, z) in phases.items():
        inside = f"{clock} BETWEEN '{a}' AND '{z}'"
        aggs += [
            F.expr(f"count_if({inside})").alias(f"{p}_n"),
            F.expr(f"sum(CASE WHEN {inside} THEN volume ELSE 0D END)").alias(f"{p}_v"),
            F.expr(f"sum(CASE WHEN {inside} THEN amount ELSE 0D END)").alias(f"{p}_a"),
            F.expr(f"count_if({inside} AND direction = 1)").alias(f"{p}_b"),
        ]
    wide = df.groupBy(*keys).agg(*aggs)
    rows = ", ".join(f"'{p}', {p}_n, {p}_v, {p}_a, {p}_b" for p in phases)
    return wide.selectExpr(*keys, f"stack({len(phases)}, {rows}) AS (phase, tick_count, volume, amount, _b)").selectExpr(
        *keys, "phase", "tick_count", "volume", "amount", f"{_pct('_b', 'tick_count')} AS buy_pct"
    )


def tick_features(df: DataFrame, keys: Sequence[str] = DAY, block: str = MINUTE, institutional: float = INSTITUTIONAL_MIN) -> DataFrame:
    """One row of features per group: flow, sizes, quantiles, vwap, big orders, imbalance."""
    k = list(keys)
    base = df.groupBy(*k).agg(
        F.count(F.lit(1)).alias("total_ticks"),
        F.sum("volume").alias("total_volume"),
        F.sum("amount").alias("total_amount"),
        F.expr(f"sum({BUY})").alias("total_buy_vol"),
        F.expr(f"sum({SELL})").alias("total_sell_vol"),
        F.expr("count_if(direction = 1)").alias("_buys"),
        F.avg("amount").alias("avg_trade_size"),
        F.max("amount").alias("max_trade_size"),
        F.stddev_samp("amount").alias("trade_size_std"),
        F.expr("sum(price * volume)").alias("_pv"),
        F.max("price").alias("price_high"),
        F.min("price").alias("price_low"),
    )
    sizes = exact_quantiles(
        df, k, "amount", {"median_trade_size": 0.5, "trade_size_85pct": 0.85, "trade_size_97pct": 0.97}
    )
    prices = exact_quantiles(df, k, "price", {"_pm": 0.5})
    flow = order_flow(df, k, block).groupBy(*k).agg(
        F.avg("ofi").alias("ofi_mean"),
        F.stddev_samp("ofi").alias("ofi_std"),
        F.expr("avg(CASE WHEN pos >= size - 20 THEN ofi END)").alias("ofi_last_20"),
    )
    big = big_order_stats(flag_big_orders(df, k, fixed=institutional), k)
    out = base
    for part in (sizes, prices, flow, big, trader_flow(df, k, institutional)):
        out = out.join(part, k)
    return out.selectExpr(
        *[c for c in out.columns if not c.startswith("_")],
        "total_buy_vol - total_sell_vol AS net_buy_vol",
        "try_divide(total_buy_vol, total_sell_vol) AS buy_sell_ratio",
        f"{_pct('total_buy_vol - total_sell_vol', '(total_buy_vol + total_sell_vol)')} AS net_flow_pct",
        f"{_pct('_buys', 'total_ticks')} AS buy_tick_pct",
        "coalesce(try_divide(_pv, total_volume), 0D) AS price_vwap",
        f"{_pct('price_high - price_low', '_pm')} AS price_range_pct",
    )


# --- order book --------------------------------------------------------------------------------


def _total(side: str, part: str = "levels") -> str:
    return f"aggregate({part}, 0D, (s, x) -> s + coalesce(x.{side}_volume, 0D))"


def _imbalance(bid: str, ask: str) -> str:
    return f"({bid} - {ask}) / ({bid} + {ask} + 1e-8D)"


def book_measures(df: DataFrame) -> DataFrame:
    """Depth and weighted imbalance, near/mid/far pressure, weighted mid and spread of a snapshot."""
    n = "size(levels)"

    def weighted(side: str) -> str:
        return f"aggregate(levels, 0D, (s, x) -> s + coalesce(x.{side}_volume, 0D) * ({n} + 1 - x.level))"

    parts = {"near": (1, 3), "mid": (4, 4), "far": (8, 3)}
    out = df.selectExpr(
        "*",
        f"{_total('bid')} AS _b",
        f"{_total('ask')} AS _a",
        f"{weighted('bid')} AS _wb",
        f"{weighted('ask')} AS _wa",
        "levels[0].bid_price AS best_bid",
        "levels[0].ask_price AS best_ask",
    )
    return out.selectExpr(
        *df.columns,
        "best_bid",
        "best_ask",
        f"{_imbalance('_b', '_a')} AS depth_imbalance",
        f"{_imbalance('_wb', '_wa')} AS weighted_imbalance",
        *[
            f"{_imbalance(_total('bid', f'slice(levels, {a}, {k})'), _total('ask', f'slice(levels, {a}, {k})'))} AS {p}_pressure"
            for p, (a, k) in parts.items()
        ],
        "CASE WHEN best_bid > 0 AND best_ask > 0 THEN (best_bid * _a + best_ask * _b) / (_a + _b + 1e-8D) "
        "WHEN best_ask > 0 THEN (best_bid + best_ask) / 2 ELSE best_bid END AS weighted_mid",
        "CASE WHEN best_bid > 0 AND best_ask > 0 THEN (best_ask - best_bid) / best_bid * 10000 END AS spread_bps",
    )


def order_walls(df: DataFrame, ratio: float = 3.0, strong: float = 5.0) -> DataFrame:
    """One row per level whose volume is at least ``ratio`` times the mean of its side."""
    sides = []
    for side in ("bid", "ask"):
        mean = f"({_total(side)} / size(levels))"
        sides.append(
            f"transform(filter(levels, x -> {mean} > 0 AND x.{side}_volume >= {ratio} * {mean}), x -> struct('{side}' AS side, x.level AS level, "
            f"x.{side}_price AS price, x.{side}_volume AS volume, x.{side}_volume / {mean} AS wall_ratio))"
        )
    return df.selectExpr("*", f"explode(concat({sides[0]}, {sides[1]})) AS _w").selectExpr(
        *[c for c in df.columns if c != "levels"], "_w.*", f"_w.wall_ratio >= {strong} AS is_strong"
    )


def spread_stats(measures: DataFrame, keys: Sequence[str] = DAY) -> DataFrame:
    return measures.groupBy(*keys).agg(
        F.avg("spread_bps").alias("mean_spread_bps"),
        F.max("spread_bps").alias("max_spread_bps"),
        F.min("spread_bps").alias("min_spread_bps"),
        F.stddev_pop("spread_bps").alias("spread_volatility_bps"),
        F.count("spread_bps").alias("snapshot_count"),
    )


def book_features(df: DataFrame, keys: Sequence[str] = DAY) -> DataFrame:
    """Aggregates over a group's snapshots, with pressure, mid and walls of the latest one."""
    k = list(keys)
    m = book_measures(df)
    latest = "struct(time, seq)"
    agg = m.groupBy(*k).agg(
        F.avg("depth_imbalance").alias("depth_imbalance_mean"),
        F.stddev_pop("depth_imbalance").alias("depth_imbalance_std"),
        F.avg("weighted_imbalance").alias("weighted_imbalance_mean"),
        F.avg("spread_bps").alias("mean_spread_bps"),
        F.expr(
            "max_by(struct(weighted_mid, best_bid, best_ask, near_pressure, mid_pressure, far_pressure, levels, seq, time), "
            f"{latest})"
        ).alias("_l"),
    )
    out = agg.selectExpr("*", "_l.levels AS levels", "_l.seq AS seq")
    walls = order_walls(out.select(*k, "seq", "levels")).groupBy(*k).agg(
        F.count(F.lit(1)).alias("wall_count"),
        F.max("wall_ratio").alias("strongest_wall_ratio"),
        F.expr("max_by(side, struct(round(wall_ratio, 9), side = 'bid', -level))").alias("strongest_wall_side"),
    )
    return out.join(walls, k, "left").selectExpr(
        *k,
        "depth_imbalance_mean",
        "depth_imbalance_std",
        "weighted_imbalance_mean",
        "mean_spread_bps",
        *[f"_l.{c} AS {c}" for c in ("weighted_mid", "best_bid", "best_ask", "near_pressure", "mid_pressure", "far_pressure")],
        "coalesce(wall_count, 0) AS wall_count",
        "coalesce(strongest_wall_ratio, 0D) AS strongest_wall_ratio",
        "strongest_wall_side",
    )


# --- signals -----------------------------------------------------------------------------------


def _signal(kind: str, keys, severity: str, bullish: str, confidence: str) -> list[str]:
    return [
        *keys,
        f"'{kind}' AS signal_type",
        f"{severity} AS severity",
        f"{bullish} AS is_bullish",
        f"CAST(least(100D, {confidence}) AS DOUBLE) AS confidence",
    ]


def whale_signals(features: DataFrame, least: int = 50, periods: int = 5, rise: float = 0.03) -> DataFrame:
    """Accumulation and distribution from daily tick features and the four days before.

    A rise from a mean price of zero has no size, so it does not count as small.
    """
    frame = f"OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {periods - 1} PRECEDING AND CURRENT ROW)"
    f = features.selectExpr(
        "*",
        f"count_if(net_buy_vol > 0) {frame} AS _up",
        f"count_if(net_buy_vol < 0) {frame} AS _down",
        f"try_divide(max(price_vwap) {frame}, first(price_vwap) {frame}) - 1 AS _rise",
    ).filter(f"total_ticks >= {least}")
    size = "least(abs(institutional_net_flow) / 10000, 20D)"
    buy = f"(big_order_buy_ratio - 50) * 1.5 + _up * 8 + {size}"
    sell = f"(50 - big_order_buy_ratio) * 1.5 + _down * 8 + {size}"

    def sev(c: str) -> str:
        return f"CASE WHEN {c} > 75 THEN 'alert' ELSE 'warning' END"

    acc = f.filter(f"big_order_buy_ratio >= 60 AND _up >= 2 AND _rise <= {rise} AND institutional_net_flow > 0")
    dis = f.filter("big_order_buy_ratio <= 40 AND _down >= 2 AND institutional_net_flow < 0")
    return acc.selectExpr(*_signal("whale_accumulation", DAY, sev(buy), "true", buy)).unionByName(
        dis.selectExpr(*_signal("whale_distribution", DAY, sev(sell), "false", sell))
    )


def wash_windows(df: DataFrame, keys: Sequence[str] = DAY, block: str = MINUTE, width: int = 20, least_volume: float = 1000) -> DataFrame:
    """Symmetry x alternation of every window of ``width`` prints, stepping by half a window.

    Windows start at multiples of the step below ``size - width``; each holds ``width`` rows.
    """
    step = width // 2
    placed = with_positions(df, keys, block, ORDER)
    in_windows = placed.selectExpr(
        *keys,
        "pos",
        "size",
        "direction",
        "volume",
        f"explode(sequence(greatest(CAST(floor(pos / {step}) AS BIGINT) - 1, 0L), CAST(floor(pos / {step}) AS BIGINT))) AS win",
    ).filter(f"win * {step} < size - {width} AND pos < win * {step} + {width}")
    per = in_windows.groupBy(*keys, "win").agg(
        F.expr(f"sum({BUY})").alias("_b"),
        F.expr(f"sum({SELL})").alias("_s"),
        F.count(F.lit(1)).alias("_n"),
        F.sort_array(F.collect_list(F.struct("pos", "direction"))).alias("_d"),
    )
    changes = "size(filter(sequence(1, size(_d) - 1), j -> _d[j].direction <> _d[j - 1].direction))"
    return per.filter(f"greatest(_b, _s) >= {least_volume}").selectExpr(
        *keys, "win", f"least(_b, _s) / greatest(_b, _s + 1) * {changes} / _n AS score"
    )


def wash_signals(df: DataFrame, keys: Sequence[str] = DAY, block: str = MINUTE, least: int = 50, width: int = 20,
                 least_volume: float = 1000, notable: float = 0.5, alarm: float = 0.6) -> DataFrame:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(f"_n >= {least}")
    scored = wash_windows(df, keys, block, width, least_volume).filter(f"score > {notable}")
    top = scored.groupBy(*keys).agg(
        F.max("score").alias("wash_score"), F.count(F.lit(1)).alias("windows"), F.avg("score").alias("avg_score")
    )
    top = top.join(sizes, list(keys), "left_semi").filter(f"wash_score >= {alarm}")
    return top.selectExpr(
        *_signal("wash_trading", keys, "CASE WHEN wash_score * 100 < 85 THEN 'warning' ELSE 'alert' END", "false", "wash_score * 100"),
        "wash_score",
        "windows",
        "avg_score",
    )


def anomaly_signals(df: DataFrame, keys: Sequence[str] = DAY, sigmas: float = 4.0, least: int = 20) -> DataFrame:
    """Prints whose amount lies ``sigmas`` sample deviations above the group mean."""
    stats = df.groupBy(*keys).agg(
        F.avg("amount").alias("_m"), F.stddev_samp("amount").alias("_s"), F.count(F.lit(1)).alias("_n")
    ).filter(f"_n >= {least} AND _s > 0")
    hits = df.join(stats, list(keys)).selectExpr("*", "(amount - _m) / _s AS _z").filter(f"_z > {sigmas}")
    agg = hits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("anomaly_count"),
        F.max("_z").alias("max_z_score"),
        F.sum("amount").alias("anomaly_amount"),
        F.max("_n").alias("_n"),
    )
    return agg.selectExpr(
        *_signal(
            "anomaly_trade", keys, "CASE WHEN anomaly_count < _n * 0.02 THEN 'warning' ELSE 'alert' END", "false",
            "anomaly_count / _n * 1000 + max_z_score * 5",
        ),
        "anomaly_count",
        "max_z_score",
        "anomaly_amount",
    )


def surge_signals(df: DataFrame, keys: Sequence[str] = DAY, width: str = "minute", sigmas: float = 3.0, least: int = 100) -> DataFrame:
    top = tick_surge(df, keys, width, sigmas, least).groupBy(*keys).agg(
        F.max("multiplier").alias("max_multiplier"), F.count(F.lit(1)).alias("surge_periods")
    )
    return top.selectExpr(
        *_signal("tick_surge", keys, "CASE WHEN max_multiplier < 5 THEN 'info' ELSE 'warning' END", "true", "max_multiplier * 25"),
        "surge_periods",
    )


def wall_signals(book: DataFrame, keys: Sequence[str] = DAY, strong: float = 5.0) -> DataFrame:
    """The strongest wall of each group, if strong enough."""
    top = order_walls(book).groupBy(*keys).agg(
        F.expr("max_by(struct(side, level, wall_ratio), struct(round(wall_ratio, 9), side, -level, -seq))").alias("w")
    ).filter(f"w.wall_ratio >= {strong}")
    return top.selectExpr(
        *_signal("order_wall", keys, "CASE WHEN w.side = 'bid' THEN 'info' ELSE 'warning' END", "w.side = 'bid'", "w.wall_ratio * 15")
    )


def imbalance_signals(book: DataFrame, keys: Sequence[str] = DAY, extreme: float = 0.7) -> DataFrame:
    """Extreme depth imbalance of the latest snapshot."""
    last = book_measures(book).groupBy(*keys).agg(F.expr("max_by(depth_imbalance, struct(time, seq))").alias("x"))
    return last.filter(f"abs(x) >= {extreme}").selectExpr(
        *_signal("depth_imbalance", keys, "CASE WHEN abs(x) < 0.85 THEN 'warning' ELSE 'alert' END", "x > 0", "abs(x) * 120")
    )


def merge_signals(parts: Sequence[DataFrame], keys: Sequence[str] = DAY) -> DataFrame:
    """All signals, ranked per group by severity and then confidence, with the group's flags."""
    cols = [*keys, "signal_type", "severity", "is_bullish", "confidence"]
    union = parts[0].select(*cols)
    for p in parts[1:]:
        union = union.unionByName(p.select(*cols))
    k = ", ".join(keys)
    level = "CASE severity WHEN 'critical' THEN 3 WHEN 'alert' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END"
    return union.selectExpr(
        *cols,
        f"row_number() OVER (PARTITION BY {k} ORDER BY {level} DESC, round(confidence, 9) DESC, signal_type) AS signal_rank",
        f"count(1) OVER (PARTITION BY {k}) AS signal_count",
        f"max(severity IN ('alert', 'critical')) OVER (PARTITION BY {k}) AS has_alert",
        f"max(severity = 'warning') OVER (PARTITION BY {k}) AS has_warning",
    )
