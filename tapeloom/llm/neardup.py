"""Near-duplicate vectors by dual traversal of cover trees, exact at the threshold.

Vectors are cut into cells around bounded pivots, each cell gets a cover tree, and pairs of cells whose pivots allow a link
are traversed together: a node pair too far apart for its radii is pruned, one close enough links whole, the rest
descends to its children, down to single points, whose cosine decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import covertree as ct
from tapeloom.llm.common import table
from tapeloom.llm.graph import components, local_labels

# Distances of unit vectors come from differences of squares; bounds give way by this much, single points decide exactly.
SLACK = 1e-6
# Cells of a tile; a task compares two tiles.
TILE_CELLS = 4


class Links:
    """Links found between the points of two trees: weights linked to each point, and a spanning set of links."""

    def __init__(self, a: ct.Tree, b: ct.Tree):
        self.a, self.b = a, b
        self.heavy = [np.append(0, np.cumsum(t.weights)) for t in (a, b)]
        self.steps = [np.zeros(len(t) + 1, np.int64) for t in (a, b)]
        self.labels = np.arange(len(a) + len(b))

    def whole(self, x: np.ndarray, y: np.ndarray) -> None:
        """Node pairs all of whose points are linked."""
        for (t, at, k), (u, to, m) in (((self.a, x, 0), (self.b, y, 1)), ((self.b, y, 1), (self.a, x, 0))):
            weight = self.heavy[m][u.end[to]] - self.heavy[m][u.begin[to]]
            np.add.at(self.steps[k], t.begin[at], weight)
            np.add.at(self.steps[k], t.end[at], -weight)
        n = len(self.a)
        for p, q in set(zip(x.tolist(), y.tolist())):
            left, right = np.arange(self.a.begin[p], self.a.end[p]), n + np.arange(self.b.begin[q], self.b.end[q])
            i, j = np.append(left, right), np.append(np.full(len(left), right[0]), np.full(len(right), left[0]))
            self.labels = local_labels(0, i, j, self.labels)

    def single(self, x: np.ndarray, y: np.ndarray) -> None:
        np.add.at(self.steps[0], x, self.b.weights[y])
        np.add.at(self.steps[0], x + 1, -self.b.weights[y])
        np.add.at(self.steps[1], y, self.a.weights[x])
        np.add.at(self.steps[1], y + 1, -self.a.weights[x])
        self.labels = local_labels(0, x, y + len(self.a), self.labels)

    def rows(self, same: bool) -> pa.Table:
        """(id, other, n): weight linked to each id here, and the first id of its local component."""
        ids = np.append(self.a.ids, self.b.ids)
        counts = np.concatenate([np.cumsum(s[:-1]) for s in self.steps])
        kept = np.flatnonzero((counts > 0) & (np.arange(len(ids)) < (len(self.a) if same else len(ids))))
        first = np.minimum.reduceat(ids[np.argsort(self.labels, kind="stable")], np.flatnonzero(np.diff(np.append(-1, np.sort(self.labels)))))
        of = np.unique(self.labels, return_inverse=True)[1]
        return pa.table({"id": ids[kept], "other": first[of[kept]], "n": counts[kept]})


def traverse(a: ct.Tree, b: ct.Tree, cosine: float) -> Links:
    found, reach = Links(a, b), float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    stack = [(np.array([0]), np.array([0]))]
    while stack:
        x_all, y = stack.pop()
        for at in range(0, len(x_all), 1024):
            x = x_all[at : at + 1024]
            dots = a.points[a.begin[x]] @ b.points[b.begin[y]].T
            one = (a.end[x] - a.begin[x] == 1)[:, None] & (b.end[y] - b.begin[y] == 1)
            i, j = np.nonzero(one & (dots >= cosine))
            if len(i):
                found.single(a.begin[x[i]], b.begin[y[j]])
            if one.all():
                continue
            apart, room = np.sqrt(np.maximum(2 - 2 * dots, 0)), a.radius[x][:, None] + b.radius[y]
            inside = ~one & (apart + room <= reach - SLACK)
            i, j = np.nonzero(inside)
            if len(i):
                found.whole(x[i], y[j])
            i, j = np.nonzero(~one & ~inside & (apart - room <= reach + SLACK))
            for p, q in zip(x[i].tolist(), y[j].tolist()):
                left = np.arange(a.child[p], a.last[p]) if a.last[p] > a.child[p] else np.array([p])
                right = np.arange(b.child[q], b.last[q]) if b.last[q] > b.child[q] else np.array([q])
                stack.append((left, right))
    return found


def valid(vector: str) -> str:
    """SQL for a vector that may link: no null or non-finite component, and not zero."""
    v = f"`{vector}`"
    return f"{v} IS NOT NULL AND forall({v}, x -> x IS NOT NULL AND abs(x) < double('Infinity')) AND exists({v}, x -> x <> 0)"


def pivot_groups(centres: np.ndarray, size: int) -> np.ndarray:
    """Group number of each pivot: a pivot and its nearest ones not yet grouped, ``size`` together."""
    group, k = np.full(len(centres), -1), 0
    while (group < 0).any():
        free = np.flatnonzero(group < 0)
        near = ct.distances(centres[free], centres[free[:1]])[:, 0]
        group[free[np.argsort(near, kind="stable")[:size]]] = k
        k += 1
    return group


def tile_pairs(grown: DataFrame, centres: np.ndarray, allowed: np.ndarray) -> DataFrame:
    """Each tree once for every tile that its own tile must be compared with, under the pair's key (low, high).

    A tile holds the cells of a few near pivots, TILE_CELLS of each pivot at most; tiles of which no pair of pivots is ``allowed``
    do not meet.
    """
    group = pivot_groups(centres, TILE_CELLS)
    meet = {(int(group[p]), int(group[q])) for p, q in zip(*np.nonzero(allowed))}
    groups = F.create_map(*[F.lit(int(x)) for p, g in enumerate(group) for x in (p, g)])
    tiled = grown.withColumn("side", F.struct(groups[F.col("pivot")].alias("g"), F.floor(F.col("cell") / TILE_CELLS).alias("s")))
    pairs = grown.sparkSession.createDataFrame(sorted(meet), "g int, h int")
    others = pairs.join(tiled.selectExpr("side.g AS h", "side.s AS s").distinct(), "h").selectExpr("g", "struct(h AS g, s) AS other")
    rows = tiled.withColumn("g", F.col("side.g")).join(others, "g").drop("g")
    return rows.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other"))


def pair_links(classes: DataFrame, width: int, cosine: float) -> DataFrame | None:
    """(id, other, n) over vectors (id, weight, v) of one length: a link of each class to another, or to itself, that connects it, and the number of rows
    linked; None where there are no vectors."""

    def unit(batches):
        for b in batches:
            x = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            yield pa.RecordBatch.from_arrays([b["id"], b["weight"], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float64()))], ["id", "weight", "u"])

    units = classes.mapInArrow(unit, "id long, weight long, u array<double>")
    centres = ct.pivots(units, "u")
    if not len(centres):
        return None
    grown = table(ct.trees(ct.in_cells(units, "u", centres), "u"), "trees")
    radii = np.zeros(len(centres))

    def reach(batches):
        for b in batches:
            for row in b.to_pylist():
                tree = ct.Tree.of(row)
                far = ct.distances(tree.points, centres[row["pivot"]][None]).max()
                yield pa.RecordBatch.from_pydict({"pivot": pa.array([row["pivot"]], pa.int32()), "far": [float(far)]})

    for p, far in grown.mapInArrow(reach, "pivot int, far double").groupBy("pivot").agg(F.max("far")).collect():
        radii[p] = far
    allowed = ct.distances(centres, centres) - radii[:, None] - radii <= np.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    np.fill_diagonal(allowed, True)

    def compare(t: pa.Table) -> pa.Table:
        held = sorted(t.to_pylist(), key=lambda r: (r["pivot"], r["cell"]))
        sides = [[(r["pivot"], ct.Tree.of(r)) for r in held if r["side"] == r[end]] for end in ("low", "high")]
        same = held[0]["low"] == held[0]["high"]
        parts = [pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})]
        for i, (p, a) in enumerate(sides[0]):
            for j, (q, b) in enumerate(sides[1]):
                if allowed[p, q] and not (same and i > j):
                    parts.append(traverse(a, b, cosine).rows(same and i == j))
        return pa.concat_tables(parts)

    return table(tile_pairs(grown, centres, allowed).groupBy("low", "high").applyInArrow(compare, "id long, other long, n long"), "links")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different lengths do not link, and
    each length is compared by itself. Equal vectors are links of each other and compared once. ``component_id`` is the smallest id
    reachable, ``kept`` says that it is the row's own. Rows of one id and different vectors are one node; a row with a null
    id is compared like any other. An empty table gives an empty result. Other columns are not read.
    """
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[vector].alias("v"))
    good = rows.where(valid("v"))
    classes = good.groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("weight"))
    classes = table(classes.withColumns({"id": F.coalesce("first_id", F.xxhash64("v")), "width": F.size("v")}), "vectors")
    widths = sorted(r[0] for r in classes.select("width").distinct().collect())
    found = None
    for width in widths:
        part = pair_links(classes.where(F.col("width") == width).select("id", "weight", "v"), width, cosine)
        found = part if found is None else found.unionByName(part) if part is not None else found
    if found is None:
        return rows.selectExpr("vec_id", "0L AS n_links", "vec_id AS component_id", "true AS kept")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    comp = components(found.selectExpr("id AS a", "other AS b"))
    known = classes.join(counts, "id").join(comp, classes["id"] == comp["node"], "left").withColumn("component", F.coalesce("component", "id"))
    least = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = known.join(least, "component").select("v", "n", "component_id")
    linked = good.join(of_class, "v").selectExpr("vec_id", "n - 1 AS n_links", "component_id")
    alone = rows.where(f"NOT coalesce({valid('v')}, false)").selectExpr("vec_id", "0L AS n_links", "vec_id AS component_id")
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
