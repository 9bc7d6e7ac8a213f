"""Exact top-k inner products by dual-tree search.

Queries and candidates are indexed by cover trees of the same kind. A pair of nodes can reach at most
q.c + r_q |c| + r_c |q| + r_q r_c for its centres and radii; it is pruned when that is below the worst k-th score so far of the
queries under the node. Tasks hold a tree of queries and a few trees of candidates; the best of each task meet by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm import covertree as ct
from tapeloom.llm.common import table

# Candidate trees of one task.
TREES = 2


class Search:
    """The best ``k`` candidates so far of each query of a tree, higher score first, then smaller id."""

    def __init__(self, queries: ct.Tree, k: int):
        self.q, self.k = queries, k
        self.score = np.full((len(queries), k), -np.inf)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max)

    def worst(self, nodes: np.ndarray) -> np.ndarray:
        kth = self.score[:, -1]
        out = kth[self.q.begin[nodes]]
        for i in np.flatnonzero(self.q.end[nodes] - self.q.begin[nodes] > 1):
            out[i] = kth[self.q.begin[nodes[i]] : self.q.end[nodes[i]]].min()
        return out

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of the query rows with candidates ``ids``."""
        scores = np.where(self.q.ids[rows][:, None] == ids, -np.inf, scores)
        least = self.score[rows, -1]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        r, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(r):
            return
        hit = np.unique(r)
        of = np.searchsorted(hit, r)
        row = np.concatenate([np.repeat(np.arange(len(hit)), self.k), of])
        score = np.concatenate([self.score[rows[hit]].ravel(), scores[r, c]])
        name = np.concatenate([self.id[rows[hit]].ravel(), ids[c]])
        order = np.lexsort((name, -score, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], np.arange(len(hit)))[row[order]]
        best = order[place < self.k]
        self.score[rows[hit]] = score[best].reshape(-1, self.k)
        self.id[rows[hit]] = name[best].reshape(-1, self.k)

    def visit(self, t: ct.Tree, x: np.ndarray, y: np.ndarray) -> None:
        """Query nodes ``x`` against candidate nodes ``y`` of ``t``."""
        for at in range(0, len(x), 512):
            for to in range(0, len(y), 2048):
                self._block(t, x[at : at + 512], y[to : to + 2048])

    def _block(self, t: ct.Tree, x: np.ndarray, y: np.ndarray) -> None:
        q, c = self.q.points[self.q.begin[x]], t.points[t.begin[y]]
        dots = q @ c.T
        lone_q, lone_c = self.q.end[x] - self.q.begin[x] == 1, t.end[y] - t.begin[y] == 1
        if lone_q.any() and lone_c.any():
            self.offer(self.q.begin[x[lone_q]], dots[np.ix_(lone_q, lone_c)], t.ids[t.begin[y[lone_c]]])
        if lone_q.all() and lone_c.all():
            return
        size_q, size_c = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
        rq, rc = self.q.radius[x], t.radius[y]
        most = dots + rq[:, None] * size_c + size_q[:, None] * rc + rq[:, None] * rc
        most += 1e-9 * (1 + np.abs(most))
        for j in np.flatnonzero(~lone_c)[np.argsort(-most[:, ~lone_c].max(axis=0), kind="stable")]:
            open_ = lone_q & (most[:, j] >= self.worst(x))
            if open_.any():
                self.visit(t, x[open_], np.arange(t.child[y[j]], t.last[y[j]]))
        for i in np.flatnonzero(~lone_q):
            open_ = most[i] >= self.worst(x[i : i + 1])[0]
            if open_.any():
                down = np.concatenate([np.arange(t.child[n], t.last[n]) if t.last[n] > t.child[n] else [n] for n in y[open_]])
                self.visit(t, np.arange(self.q.child[x[i]], self.q.last[x[i]]), down)


def finite(vector: str) -> str:
    v = f"`{vector}`"
    return f"{v} IS NOT NULL AND forall({v}, x -> x IS NOT NULL AND abs(x) < double('Infinity'))"


def best_of_length(found: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of every task for each query, over vectors (id, weight, v, asks) of one length."""
    everything = found.select("id", "weight", "v")
    queries = found.where("asks").groupBy("id").agg(F.min("v").alias("v")).selectExpr("id", "1L AS weight", "v")
    groups = max(1, -(-queries.count() // ct.CELL))
    asking = ct.trees(queries.selectExpr("*", "0 AS pivot", f"cast(pmod(xxhash64(id), {groups}) AS int) AS cell"), "v")
    grown = table(ct.trees(ct.in_cells(everything, "v", ct.pivots(everything, "v")), "v"), "trees")
    tiles = max(1, -(-grown.count() // TREES))
    left = asking.selectExpr("0 AS side", "cell AS q", f"explode(sequence(0, {tiles - 1})) AS tile", "ids", "weights", "points", "nodes")
    right = grown.selectExpr("1 AS side", f"explode(sequence(0, {groups - 1})) AS q", f"cast(pmod(xxhash64(pivot, cell), {tiles}) AS int) AS tile", "ids", "weights", "points", "nodes")

    def search(t: pa.Table) -> pa.Table:
        held = t.sort_by([("side", "ascending")]).to_pylist()
        none = np.zeros(0, np.int64)
        if held[0]["side"] or not held[-1]["side"]:
            return pa.table({"query_id": none, "vec_id": none, "score": none})
        work = Search(ct.Tree.of(held[0]), k)
        for tree in map(ct.Tree.of, held[1:]):
            work.visit(tree, np.array([0]), np.array([0]))
        i, j = np.nonzero(work.score > -np.inf)
        return pa.table({"query_id": work.q.ids[i], "vec_id": work.id[i, j], "score": work.score[i, j].astype(np.int64)})

    return left.unionByName(right).groupBy("q", "tile").applyInArrow(search, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, is_query: str, id_col: str = "vec_id", vector: str = "embedding", k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which the SQL ``is_query`` holds, the ``k`` other rows of highest
    inner product of floor(scale * component), smaller ids first among equals; all, if there are fewer.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null id. Vectors of different lengths have
    no product: a query meets the rows of its length. Rows of one id are candidates each, but for that id's own query; the smallest vector
    of an id and a length asks. An empty table gives an empty result. Other columns are not read.
    """
    rows = df.select(df[id_col].cast("long").alias("id"), df[vector].alias("v"), F.expr(is_query).alias("asks"))
    rows = rows.where(f"id IS NOT NULL AND size(v) > 0 AND ({finite('v')})")
    found = table(rows.selectExpr("id", "1L AS weight", f"transform(v, x -> double(floor({scale} * double(x)))) AS v", "asks", "size(v) AS width"), "vectors")
    widths = sorted(r[0] for r in found.where("asks").select("width").distinct().collect())
    if not widths:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = None
    for width in widths:
        part = best_of_length(found.where(F.col("width") == width), k)
        best = part if best is None else best.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
