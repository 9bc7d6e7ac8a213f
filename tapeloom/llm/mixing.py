"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell (source, language, topic). Raking scales the cells to one target marginal after the other until
all agree, with no cell beyond its tokens; a document is then drawn with the probability that makes its cell's expected tokens the
cell's share of the budget. The draw is a hash of the id, so it is the same in every run. Only DataFrame operations are used.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import table
from tapeloom.session import cut_lineage

WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"
# Kind of text, from its surface: SQL over the text, never null, and its number of tokens.
TOPIC = "CASE WHEN contains(_text, ' | ') THEN 'table' WHEN contains(_text, '!!') THEN 'loud' WHEN _tokens < 100 THEN 'short' ELSE 'prose' END"
DIMENSIONS = ("source", "lang", "topic")
# Target marginals: the token shares raised to these powers, so that small sources and languages gain.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 1.0}
# Raking ends when no cell's part of its tokens changes by more in a sweep over all marginals.
SETTLED = 1e-9
# Sweeps after which marginals that contradict each other, and so never settle, are given up; it is logged.
MOST_SWEEPS = 60
FRACTION = 0.5
# Cells up to which their probabilities are sent to all executors; more are joined, each cell in SALTS parts.
SENT_CELLS = 100_000
SALTS = 64
# Shares of the budget that miss their target by more are reported.
NOTED = 1e-4
LOG = logging.getLogger(__name__)


def tempered(cells: DataFrame, name: str, power: float) -> DataFrame:
    """(name, target): shares of tokens raised to ``power``, summing to one."""
    sums = cells.groupBy(name).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("raw"))
    total = sums.agg(F.sum("raw").alias("total"))
    return sums.join(F.broadcast(total)).select(name, (F.col("raw") / F.col("total")).alias("target"))


def level(df: DataFrame, share: str = "share", room: str = "room") -> float:
    """The factor f for which least(room, f * share) sums to one; if all rooms together are less, one that fills them all.

    Newton's steps on the sums: the sum is concave in the factor, so after the first the steps only rise, to the exact factor.
    """
    at = 1.0
    for step in range(200):
        raised = F.col(share) * F.lit(at)
        row = df.where(F.col(share) > 0).agg(
            F.sum(share), F.sum(F.when(raised < F.col(room), F.col(share))), F.sum(F.when(raised >= F.col(room), F.col(room)))
        ).first()
        every, free, held = row[0], row[1] or 0.0, row[2] or 0.0
        if not every or (not free and (step or held <= 1)):
            return at
        new = max(1 / every if not step else at, (1 - held) / free if free else 0.0)
        if abs(new / at - 1) <= 1e-13:
            return new
        at = new
    return at


def reachable(now: DataFrame, name: str) -> DataFrame:
    """(name, to_name): the targets of one marginal that a draw without repeats can reach. A value without the tokens for its
    target has all it has, and what it lacks goes to the others in proportion."""
    values = now.where("share > 0").groupBy(name).agg(F.first(f"to_{name}").alias("share"), F.sum("room").alias("room"))
    values = cut_lineage(values)
    return values.select(name, F.least(F.col("room"), F.col("share") * F.lit(level(values))).alias(f"to_{name}"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], fraction: float | None = None, settled: float = SETTLED, most_sweeps: int = MOST_SWEEPS) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``share``: the fitted share of each cell. A target value without cells is left out; a
    value without target has share zero.

    With ``fraction``, shares are of a budget of that part of all tokens, and no cell has more than its tokens: a share is the least of
    that room and a product of one factor for each dimension. Each visit to a marginal solves for its factors given the cells that are full
    now, so what full cells can't take goes to the others of the same value, and a cell that is full too early is freed again. Targets
    beyond what a value has are lowered to that; the budget is met whenever the cells with targets have the tokens.

    Sweeps over the marginals go on until none moves a cell by more than ``settled`` of its tokens (without ``fraction``, of its share).
    """
    total = cells.agg(F.sum("tokens").cast("double").alias("total"))
    now = cells.join(F.broadcast(total)).withColumn("share", F.col("tokens") / F.col("total"))
    room = F.col("tokens") / (F.col("total") * F.lit(fraction)) if fraction else F.lit(float("inf"))
    now = now.withColumn("room", room).drop("total")
    for name, target in targets.items():
        now = now.join(target.select(name, F.col("target").alias(f"to_{name}")), name, "left")
        now = now.withColumn("share", F.when(F.col(f"to_{name}") > 0, F.col("share")).otherwise(F.lit(0.0)))
    now = cut_lineage(now)
    if fraction:
        lowered = {name: reachable(now, name) for name in targets}
        for name, target in lowered.items():
            now = now.drop(f"to_{name}").join(target, name, "left")
        now = cut_lineage(now)
    held = F.least("share", "room")
    moved = F.abs(held - F.least("before", "room")) / (F.col("room") if fraction else F.greatest("share", "before"))
    for sweep in range(most_sweeps):
        now = now.withColumn("before", F.col("share"))
        for name in targets:
            now = cut_lineage(fitted_to(now, name))
        gap = now.where("share > 0").agg(F.max(moved)).first()[0] or 0.0
        now = now.drop("before")
        if gap <= settled:
            break
    else:
        LOG.warning("mix: after %d sweeps a cell still moves by %.2g of its tokens", most_sweeps, gap)
    if fraction:
        now = now.withColumn("share", F.least(F.col("room"), F.col("share") * F.lit(level(now))))
    return now.drop("room", *[f"to_{name}" for name in targets])


def fitted_to(now: DataFrame, name: str) -> DataFrame:
    """``now`` after one visit to the marginal ``name``."""
    full, live, to = F.col("share") >= F.col("room"), F.col("share") > 0, F.col(f"to_{name}")
    sums = now.where(live).groupBy(name).agg(
        F.sum("share").alias("sum"),
        F.coalesce(F.sum(F.when(~full, F.col("share"))), F.lit(0.0)).alias("free"),
        F.coalesce(F.sum(F.when(full, F.col("room"))), F.lit(0.0)).alias("held"),
        F.sum("room").alias("most"),
        F.max(F.col("room") / F.col("share")).alias("fills"),
    )
    factor = F.when(to >= F.col("most") * F.lit(1 - 1e-12), F.col("fills")).otherwise(
        F.greatest(to / F.col("sum"), F.try_divide(to - F.col("held"), F.col("free")))
    )
    # Without a fit the factors of some cells grow or shrink for ever.
    bound = F.least(F.lit(1e100), F.greatest(F.lit(1e-100), F.col("share") * factor))
    return now.join(sums, name, "left").withColumn("share", F.when(live, bound).otherwise(F.lit(0.0))).drop("sum", "free", "held", "most", "fills")


def reached(fitted: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(dimension, value, target, reached): every target beside the share of the budget that its cells have."""
    out = None
    for name, target in targets.items():
        sums = fitted.groupBy(name).agg(F.sum("share").alias("reached"))
        part = target.join(sums, name, "full").select(
            F.lit(name).alias("dimension"), F.col(name).alias("value"), F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("reached", F.lit(0.0)).alias("reached")
        )
        out = part if out is None else out.unionByName(part)
    return out


def report(fitted: DataFrame, targets: dict[str, DataFrame]) -> None:
    """A warning that names the worst of the targets that the fitted shares miss by more than NOTED."""
    missed = reached(fitted, targets).where(F.abs(F.col("reached") - F.col("target")) > NOTED)
    for r in missed.orderBy(F.abs(F.col("reached") - F.col("target")).desc(), "dimension", "value").limit(20).collect():
        LOG.warning("mix: %s %s has %.6f of the budget, target %.6f", r.dimension, r.value, r.reached, r.target)


def with_strata(df: DataFrame, topic: str = TOPIC) -> DataFrame:
    """``df`` (doc_id, text, source, lang, ...) with _tokens, _source, _lang, _topic; null text is empty, null values are 'unknown'."""
    read = df.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_tokens", F.expr(f"CAST(regexp_count(_text, '{WORD}') AS LONG)"))
    named = {f"_{c}": F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in ("source", "lang")}
    return read.withColumns(named | {"_topic": F.coalesce(F.expr(topic), F.lit("unknown"))}).drop("_text")


def mix(df: DataFrame, targets: dict[str, DataFrame] | None = None, fraction: float = FRACTION, temper: dict[str, float] = TEMPER) -> DataFrame:
    """``df`` with _tokens, _source, _lang, _topic, _probability and _copies (0 or 1) of every row.

    ``targets`` gives a marginal (value, target) for any dimension; the others are tempered token shares. The budget is
    ``fraction`` of all tokens. A cell whose share would take more than its tokens is kept whole, and others with its values make up for it;
    targets that can't be reached so are logged. Rows of one id are drawn
    together; a null id counts as empty text. Documents without words, and cells without tokens, have probability zero. An empty table gives an empty
    result. Other columns pass through, and must not start with an underscore.
    """
    docs = with_strata(df)
    keys = [f"_{d}" for d in DIMENSIONS]
    grouped = docs.groupBy(*keys).agg(F.sum("_tokens").alias("tokens")).where("tokens > 0")
    cells = table(grouped.select(*[F.col(k).alias(d) for k, d in zip(keys, DIMENSIONS)], "tokens"), "cells")
    wanted = {d: (targets or {}).get(d, None) for d in DIMENSIONS}
    wanted = {d: t if t is not None else tempered(cells, d, temper[d]) for d, t in wanted.items()}
    fitted = rake(cells, wanted, fraction)
    report(fitted, wanted)
    total = cells.agg(F.sum("tokens").cast("double").alias("total"))
    chance = fitted.join(F.broadcast(total)).select(
        *[F.col(d).alias(k) for d, k in zip(DIMENSIONS, keys)],
        F.least(F.lit(1.0), F.col("share") * F.col("total") * F.lit(fraction) / F.col("tokens")).alias("_probability"),
    )
    drawn = F.expr("CAST(conv(substr(md5(coalesce(CAST(doc_id AS STRING), '')), 1, 8), 16, 10) AS DOUBLE) / 4294967296")
    if cells.count() <= SENT_CELLS:
        placed = docs.join(F.broadcast(chance), keys, "left")
    else:
        spread = chance.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = docs.withColumn("_salt", F.expr(f"CAST(pmod(xxhash64(doc_id), {SALTS}) AS INT)"))
        placed = salted.join(spread, [*keys, "_salt"], "left").drop("_salt")
    placed = placed.withColumn("_probability", F.when(F.col("_tokens") > 0, F.coalesce("_probability", F.lit(0.0))).otherwise(F.lit(0.0)))
    return placed.withColumn("_copies", (drawn < F.col("_probability")).cast("int"))


def oracle(documents: str = "documents") -> str:
    """The same for DuckDB, over a table with the columns of documents: bounded raking as a recursion over visits to the marginals.

    Water levels are taken from the cells in order of their fill: of all the factors that fill the first k cells, the largest is the one that
    fills the budget. The recursion always makes MOST_SWEEPS sweeps; those after the cells have settled change nothing.
    """

    def level(table: str, by: str) -> str:
        return f"""(SELECT {by}, CASE WHEN all_rooms <= 1 THEN fills ELSE greatest(1 / all_shares, coalesce(best, 0)) END AS f FROM (
  SELECT {by}, sum(share) AS all_shares, sum(room) AS all_rooms, max(room / share) AS fills, max(CASE WHEN rest > 1e-15 * share THEN (1 - filled) / rest END) AS best FROM (
    SELECT *, sum(room) OVER o AS filled, sum(share) OVER (PARTITION BY {by}) - sum(share) OVER o AS rest FROM {table} WHERE share > 0 WINDOW o AS (PARTITION BY {by} ORDER BY room / share, share ROWS UNBOUNDED PRECEDING)) GROUP BY {by}))"""

    raw = ", ".join(f"t_{d} AS (SELECT {d}, power(sum(tokens)::DOUBLE, {TEMPER[d]}) / sum(power(sum(tokens)::DOUBLE, {TEMPER[d]})) OVER () AS share, sum(room) AS room, 1 AS one FROM cells GROUP BY {d})" for d in DIMENSIONS)
    lowered = ", ".join(f"l_{d} AS (SELECT t.{d}, least(t.room, t.share * v.f) AS goal FROM t_{d} t JOIN {level(f't_{d}', 'one')} v USING (one))" for d in DIMENSIONS)
    turn = f"CASE k % {len(DIMENSIONS)} " + " ".join(f"WHEN {j} THEN {{{j}}}" for j in range(len(DIMENSIONS))) + " END"
    key, goal = turn.format(*DIMENSIONS), turn.format(*[f"to_{d}" for d in DIMENSIONS])
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(text, '') AS _text, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS _tokens FROM {documents}),
docs AS MATERIALIZED (SELECT doc_id, source, lang, {TOPIC} AS topic, _tokens AS n_tokens FROM words),
cells AS MATERIALIZED (SELECT *, tokens::DOUBLE / (sum(tokens) OVER () * {FRACTION}::DOUBLE) AS room FROM (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0)),
{raw},
{lowered},
steps AS (
  SELECT 0 AS k, source, lang, topic, room, {", ".join(f"l_{d}.goal AS to_{d}" for d in DIMENSIONS)}, tokens::DOUBLE / sum(tokens) OVER () AS share
  FROM cells {" ".join(f"JOIN l_{d} USING ({d})" for d in DIMENSIONS)}
  UNION ALL
  SELECT k + 1, source, lang, topic, room, {", ".join(f"to_{d}" for d in DIMENSIONS)},
    least(1e100, greatest(1e-100, share * CASE WHEN goal >= most * (1 - 1e-12) THEN fills ELSE greatest(goal / total, CASE WHEN free > 0 THEN (goal - held) / free ELSE 0 END) END))
  FROM (SELECT *, sum(share) OVER g AS total, coalesce(sum(share) FILTER (share < room) OVER g, 0) AS free, coalesce(sum(room) FILTER (share >= room) OVER g, 0) AS held,
      sum(room) OVER g AS most, max(room / share) OVER g AS fills
    FROM (SELECT *, {key} AS dim, {goal} AS goal FROM steps WHERE k < {MOST_SWEEPS * len(DIMENSIONS)}) WINDOW g AS (PARTITION BY dim))),
fitted AS MATERIALIZED (SELECT *, 1 AS one FROM steps WHERE k = {MOST_SWEEPS * len(DIMENSIONS)}),
p AS (SELECT source, lang, topic, least(1.0, least(room, share * v.f) / room) AS probability FROM fitted JOIN {level("fitted", "one")} v USING (one))
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(probability, 0), 6) AS probability,
       (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::UINTEGER / 4294967296.0::DOUBLE < coalesce(probability, 0))::INTEGER AS copies
FROM docs LEFT JOIN p USING (source, lang, topic)"""
