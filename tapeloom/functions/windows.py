"""Window frames and the generic per-instrument window functions, as Spark SQL expressions.

Operators add columns with ``df.selectExpr``, so each helper returns SQL text. Every instrument
frame is partitioned by ``code`` and ordered by ``date``: any number of columns share one exchange
and one sort. A partition holds the sessions of one instrument, so its size is bounded by the
length of the calendar and not by the volume of the data.
"""

from __future__ import annotations

KEY = "code"
ORDER = "date"
SERIES = f"OVER (PARTITION BY {KEY} ORDER BY {ORDER})"
SO_FAR = f"OVER (PARTITION BY {KEY} ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BEFORE = f"OVER (PARTITION BY {KEY} ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def rows(n: int, skip: int = 0, by: str = KEY, order: str = ORDER) -> str:
    """The last ``n`` rows, ending ``skip`` rows before the current one."""
    end = f"{skip} PRECEDING" if skip else "CURRENT ROW"
    return f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {n - 1 + skip} PRECEDING AND {end})"


def running(by: str, order: str = ORDER, skip: int = 0) -> str:
    """From the first row of the partition to ``skip`` rows before the current one."""
    end = f"{skip} PRECEDING" if skip else "CURRENT ROW"
    return f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND {end})"


def ahead(skip: int = 0, by: str = KEY, order: str = ORDER) -> str:
    """Rows from ``skip`` rows after the current one to the end.

    Written as a running frame in descending order: a frame that ends at "unbounded following" is
    recomputed from scratch for every row.
    """
    end = f"{skip} PRECEDING" if skip else "CURRENT ROW"
    return f"OVER (PARTITION BY {by} ORDER BY {order} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND {end})"


def group(*by: str) -> str:
    """The whole partition."""
    return f"OVER (PARTITION BY {', '.join(by)})"


def over(agg: str, n: int, min_periods: int = 1, skip: int = 0, of: str = "1") -> str:
    """``agg`` over a trailing frame, null until ``min_periods`` values of ``of`` are present."""
    value = f"{agg} {rows(n, skip)}"
    if min_periods <= 1:
        return value
    return f"CASE WHEN count({of}) {rows(n, skip)} >= {min_periods} THEN {value} END"


def ma(x: str, n: int, min_periods: int = 1, skip: int = 0) -> str:
    return over(f"avg({x})", n, min_periods, skip, x)


def hhv(x: str, n: int, skip: int = 0) -> str:
    return f"max({x}) {rows(n, skip)}"


def llv(x: str, n: int, skip: int = 0) -> str:
    return f"min({x}) {rows(n, skip)}"


def ref(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) {SERIES}"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) {SERIES}"


def exist(cond: str, n: int) -> str:
    return f"max(coalesce({cond}, false)) {rows(n)}"


def pct_change(x: str, n: int = 1) -> str:
    return f"({x} / {ref(x, n)} - 1)"


def diff(x: str, n: int = 1) -> str:
    return f"({x} - {ref(x, n)})"


def rolling_median(x: str, n: int, min_periods: int = 1, skip: int = 0) -> str:
    """Median of the frame, read from its sorted values: they are collected once, where ``percentile`` counts the frame's values anew for each row."""
    values = f"sort_array(collect_list(CAST({x} AS DOUBLE)) {rows(n, skip)})"
    middle = "(get(_f, CAST((size(_f) - 1) DIV 2 AS INT)) + get(_f, CAST(size(_f) DIV 2 AS INT))) / 2D"
    return f"get(transform(array({values}), _f -> CASE WHEN size(_f) >= {max(1, min_periods)} THEN {middle} END), 0)"


def rolling_std(x: str, n: int, ddof: int = 1) -> str:
    return f"{'stddev_samp' if ddof else 'stddev_pop'}({x}) {rows(n)}"


def rolling_corr(x: str, y: str, n: int, min_periods: int = 2) -> str:
    """Pearson correlation of the pairs in the frame; null where one side does not vary."""
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    value = f"try_divide(covar_pop({x}, {y}) {rows(n)}, stddev_pop({a}) {rows(n)} * stddev_pop({b}) {rows(n)})"
    return f"CASE WHEN count({a}) {rows(n)} >= {min_periods} THEN {value} END"


def rolling_slope(y: str, n: int, min_periods: int = 2) -> str:
    """Least-squares slope of ``y`` on the row number over the frame."""
    return over(f"regr_slope({y}, rn)", n, min_periods, of=y)


def argmax(x: str, what: str, n: int) -> str:
    """``what`` at the highest ``x`` of the frame; the earliest row wins a tie."""
    return f"max_by({what}, struct({x}, -rn)) {rows(n)}"


def argmin(x: str, what: str, n: int) -> str:
    return f"min_by({what}, struct({x}, rn)) {rows(n)}"


def rolling_pct_rank(x: str, n: int, min_periods: int = 1) -> str:
    """Average-tie percentile rank of the current value among the last ``n`` values: the mean of its first and last place in the
    sorted frame, which is collected once."""
    values = f"sort_array(collect_list({x}) {rows(n)})"
    place = f"(array_position(_f, {x}) + size(_f) + 1 - array_position(reverse(_f), {x})) / 2D / size(_f)"
    return f"get(transform(array({values}), _f -> CASE WHEN {x} IS NOT NULL AND size(_f) >= {min_periods} THEN {place} END), 0)"


def last_event(cond: str, value: str) -> str:
    """``value`` at the most recent row where ``cond`` held, the current row included."""
    return f"last(CASE WHEN {cond} THEN {value} END, true) {SO_FAR}"


ROW_INDEX = f"row_number() {SERIES}"


def run_length(cond: str) -> str:
    """Length of the current run of true rows; 0 on a false row. Needs the row number ``rn``."""
    return f"CAST(rn - coalesce(max(CASE WHEN NOT coalesce({cond}, false) THEN rn END) {SO_FAR}, 0) AS INT)"


def safe_div(a: str, b: str, default: str = "NULL") -> str:
    return f"CASE WHEN {b} <> 0 THEN {a} / {b} ELSE {default} END"


def clip(x: str, low: float, high: float) -> str:
    """Clamp, keeping null as null (``least``/``greatest`` alone would return the bound)."""
    return f"CASE WHEN ({x}) IS NOT NULL THEN least({float(high)}D, greatest({float(low)}D, {x})) END"
