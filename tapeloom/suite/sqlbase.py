"""Shared fragments of the DuckDB reference SQL: named CTEs with their dependencies."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def sql(body: str, *names: str) -> str:
    """``body`` preceded by the named CTEs and everything they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in CTES[name][0]:
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = ",\n".join(
        f"{n} AS {'' if 'UNION ALL SELECT /*step*/' in CTES[n][1] else 'MATERIALIZED '}({CTES[n][1]})" for n in ordered
    )
    return shape(f"WITH RECURSIVE {parts}\n{body}" if ordered else body)


# Results are compared at six digits, or three from 100 on. The offset keeps exact decimal halves,
# which the two engines round differently, away from the boundary.
SHAPED = "(CASE WHEN abs({x}) >= 100 THEN round({x} + 3.13e-5, 3) ELSE round({x} + 3.13e-8, 6) END)"


def shape(statement: str) -> str:
    """Replace each six-digit rounding by the shared output rounding."""
    out, pos = [], 0
    while (start := statement.find("round(", pos)) >= 0:
        depth, end = 0, start + 5
        while True:
            depth += {"(": 1, ")": -1}.get(statement[end], 0)
            if depth == 0:
                break
            end += 1
        inner = statement[start + 6 : end]
        out.append(statement[pos:start])
        if inner.endswith(", 6"):
            out.append(SHAPED.format(x=f"CAST({inner[:-3]} AS DOUBLE)"))
        else:
            out.append(f"round({shape(inner)})")
        pos = end + 1
    return "".join(out) + statement[pos:]


def r(names: str, n: int = 6) -> str:
    """``round(x, n) AS x`` for each name; adding 0.0 turns a negative zero into zero."""
    return ", ".join(f"round({x}, {n}) + 0.0 AS {x}" for x in names.split())


def i(names: str) -> str:
    return ", ".join(f"CAST({x} AS INT) AS {x}" for x in names.split())


def w(n: int, skip: int = 0) -> str:
    """The trailing instrument frame."""
    return f"(PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1 + skip} PRECEDING AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'})"


S = "(PARTITION BY code ORDER BY date)"
ALL = "(PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

cte(
    "bars",
    """
SELECT lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(6, length(CAST(l_suppkey AS VARCHAR))) AS INT), '0') AS code, CAST(wk AS DATE) AS date,
  first(px ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) AS open,
  max(px) AS high, min(px) AS low,
  last(px ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) AS close,
  close AS close_raw, sum(l_quantity) AS volume,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS amount,
  sum(l_quantity) * 100 / (1000.0 * (1 + l_suppkey % 7)) AS turnover,
  close * (1000.0 * (1 + l_suppkey % 7)) AS market_cap
FROM (SELECT *, l_extendedprice / l_quantity AS px, date_trunc('week', l_shipdate) AS wk FROM lineitem)
GROUP BY l_suppkey, wk""",
)
cte(
    "membership",
    """
SELECT lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(6, length(CAST(s_suppkey AS VARCHAR))) AS INT), '0') AS code, n_name AS block FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(6, length(CAST(s_suppkey AS VARCHAR))) AS INT), '0'), r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT DISTINCT lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(6, length(CAST(l_suppkey AS VARCHAR))) AS INT), '0'), p_brand FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
cte(
    "industry",
    """
SELECT lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(6, length(CAST(s_suppkey AS VARCHAR))) AS INT), '0') AS code, coalesce(n_name, 'UNKNOWN') AS industry
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
)
cte(
    "rsv",
    f"""
SELECT *, CASE WHEN hh > ll THEN 100 * (close - ll) / (hh - ll) ELSE 0 END AS rsv,
  (h4 - close) / d4 * 100.0 - 90.0 AS v1, (close - l4) / d4 * 100.0 AS v3,
  greatest(close - coalesce(pc, close), 0) AS gain, greatest(coalesce(pc, close) - close, 0) AS loss
FROM (SELECT *, CASE WHEN h4 - l4 <> 0 THEN h4 - l4 ELSE 1e-9 END AS d4 FROM (
  SELECT *, row_number() OVER {S} AS rn, lag(close) OVER {S} AS pc,
    max(high) OVER {w(9)} AS hh, min(low) OVER {w(9)} AS ll,
    max(high) OVER {w(4)} AS h4, min(low) OVER {w(4)} AS l4
  FROM bars))""",
    "bars",
)
# One recursion carries every recurrence, row by row; it shares nothing with the blocked form.
cte(
    "rec",
    """
SELECT code, rn, date, close AS e10, close AS white_line, close AS e12, close AS e26, CAST(0 AS DOUBLE) AS dea,
  CAST(rsv AS DOUBLE) AS k, CAST(rsv AS DOUBLE) AS d, v1 AS s2, v3 AS s4, v3 AS s5,
  CAST(gain AS DOUBLE) AS g6, CAST(loss AS DOUBLE) AS l6, CAST(gain AS DOUBLE) AS g14, CAST(loss AS DOUBLE) AS l14
FROM rsv WHERE rn = 1
UNION ALL SELECT /*step*/ code, rn, date, e10, 2/11.0*e10 + 9/11.0*pw, e12, e26, 0.2*(e12-e26) + 0.8*pdea,
  k, k/3.0 + pd*2/3.0, s2, s4, (s4 + 5*ps5)/6.0, g6, l6, g14, l14
FROM (SELECT x.code, x.rn, x.date, 2/11.0*x.close + 9/11.0*p.e10 AS e10, p.white_line AS pw,
    2/13.0*x.close + 11/13.0*p.e12 AS e12, 2/27.0*x.close + 25/27.0*p.e26 AS e26, p.dea AS pdea,
    x.rsv/3.0 + p.k*2/3.0 AS k, p.d AS pd, (x.v1 + 3*p.s2)/4.0 AS s2, (x.v3 + 5*p.s4)/6.0 AS s4, p.s5 AS ps5,
    2/7.0*x.gain + 5/7.0*p.g6 AS g6, 2/7.0*x.loss + 5/7.0*p.l6 AS l6,
    2/15.0*x.gain + 13/15.0*p.g14 AS g14, 2/15.0*x.loss + 13/15.0*p.l14 AS l14
  FROM rec p JOIN rsv x ON x.code = p.code AND x.rn = p.rn + 1)""",
    "rsv",
)
cte(
    "ind",
    f"""
SELECT b.*, white_line, k AS "K", d AS "D", 3*k - 2*d AS "J", e12 - e26 AS dif, dea, 2*(e12 - e26 - dea) AS macd,
  greatest(s5 + 100 - (s2 + 100) - 4, 0) AS brick,
  100 - 100/(1 + g6/CASE WHEN l6 = 0 THEN 1e-9 ELSE l6 END) AS rsi_6,
  100 - 100/(1 + g14/CASE WHEN l14 = 0 THEN 1e-9 ELSE l14 END) AS rsi_14,
  (avg(close) OVER {w(14)} + avg(close) OVER {w(28)} + avg(close) OVER {w(57)} + avg(close) OVER {w(114)})/4 AS yellow_line,
  avg(close) OVER {w(5)} AS ma5, avg(close) OVER {w(10)} AS ma10, avg(close) OVER {w(20)} AS ma20,
  avg(close) OVER {w(30)} AS ma30, avg(close) OVER {w(40)} AS ma40, avg(close) OVER {w(60)} AS ma60
FROM rsv b JOIN rec USING (code, rn, date)""",
    "rsv",
    "rec",
)
