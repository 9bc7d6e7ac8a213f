"""Cover trees over cells of vectors: built in tasks, sent between tasks as one row a cell.

A tree's levels are nested and their radii halve: a node's first child has the node's own centre, every point of a
node lies within the level's radius of one child's centre, and centres of one node's children are further apart than that
radius. Points are kept in the order of the leaves, so a node is a range whose first point is its centre; its radius is
the measured distance to its farthest point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a cell at most; a pivot with more is cut into several cells by a hash of the id.
CELL = 4096
# Pivots are chosen among so many rows at most (those of smallest id hash), and are so many at most.
SAMPLE = 4096
PIVOTS = 256

BLOB = "ids binary, weights binary, points binary, nodes binary"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(gap, 0, out=gap), out=gap)


def split(points: np.ndarray, members: np.ndarray, radius: float) -> list[np.ndarray]:
    """Members by centre, the centre first; the first member is the first centre."""
    near = distances(points[members], points[members[:1]])[:, 0] <= radius
    near[0] = True
    groups, rest = [[members[near]]], members[~near]
    while len(rest):
        chunk, rest = rest[:256], rest[256:]
        close = distances(points[chunk], points[chunk]) <= radius
        centres, owner = [], np.full(len(chunk), -1)
        for k in range(len(chunk)):
            if owner[k] < 0:
                mine = (owner < 0) & close[k]
                mine[k] = True
                owner[mine] = len(centres)
                centres.append(k)
        new = [[chunk[c : c + 1], chunk[(owner == i) & (np.arange(len(chunk)) != c)]] for i, c in enumerate(centres)]
        if len(rest):
            far = distances(points[rest], points[chunk[centres]])
            best = far.argmin(axis=1)
            hit = far[np.arange(len(rest)), best] <= radius
            for i in np.unique(best[hit]):
                new[i].append(rest[hit & (best == i)])
            rest = rest[~hit]
        groups += new
    return [np.concatenate(g) for g in groups]


class Tree:
    """Points and ids in leaf order; ``nodes`` has begin, end, radius, first child and end of children of each node."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, points: np.ndarray, nodes: np.ndarray):
        self.ids, self.weights, self.points = ids, weights, points
        self.begin, self.end, self.child, self.last = (nodes[:, k].astype(np.int64) for k in (0, 1, 3, 4))
        self.radius = nodes[:, 2]

    @classmethod
    def build(cls, ids: np.ndarray, weights: np.ndarray, points: np.ndarray) -> Tree:
        held = [np.arange(len(ids))]
        scale, radius, children = [np.inf], [], []
        k = 0
        while k < len(held):
            members = held[k]
            r = float(distances(points[members], points[members[:1]]).max()) if len(members) > 1 else 0.0
            radius.append(r)
            if len(members) == 1:
                children.append((0, 0))
            else:
                level = min(scale[k], r)
                while level >= r and level > 0:
                    level /= 2
                groups = split(points, members, level) if level > 0 else [members[i : i + 1] for i in range(len(members))]
                children.append((len(held), len(held) + len(groups)))
                held += groups
                scale += [level] * len(groups)
            k += 1
        begin, end = np.zeros(len(held), np.int64), np.array([len(m) for m in held])
        order = np.zeros(len(ids), np.int64)
        for k, (low, high) in enumerate(children):
            at = begin[k]
            for x in range(low, high):
                begin[x] = at
                at += end[x]
            if low == high:
                order[begin[k]] = held[k][0]
        nodes = np.column_stack([begin, begin + end, radius, np.array(children)]).astype(float)
        return cls(ids[order], weights[order], points[order], nodes)

    def blobs(self) -> dict[str, bytes]:
        nodes = np.column_stack([self.begin, self.end, self.radius, self.child, self.last]).astype("<f8")
        return {"ids": self.ids.astype("<i8").tobytes(), "weights": self.weights.astype("<i8").tobytes(), "points": self.points.astype("<f8").tobytes(), "nodes": nodes.tobytes()}

    @classmethod
    def of(cls, row: dict) -> Tree:
        ids = np.frombuffer(row["ids"], "<i8")
        nodes = np.frombuffer(row["nodes"], "<f8").reshape(-1, 5)
        return cls(ids, np.frombuffer(row["weights"], "<i8"), np.frombuffer(row["points"], "<f8").reshape(len(ids), -1), nodes)

    def __len__(self) -> int:
        return len(self.ids)


def pivots(rows: DataFrame, vector: str) -> np.ndarray:
    """Farthest-first centres among a bounded sample; their number follows the rows' up to PIVOTS."""
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(vector).toPandas()[vector]
    if not n:
        return np.zeros((0, 0))
    points = np.stack([np.asarray(v, float) for v in sample])
    chosen = [0]
    gap = distances(points, points[:1])[:, 0]
    for _ in range(min(PIVOTS, -(-n // CELL)) - 1):
        k = int(gap.argmax())
        if gap[k] <= 0:
            break
        chosen.append(k)
        gap = np.minimum(gap, distances(points, points[k : k + 1])[:, 0])
    return points[chosen]


def in_cells(rows: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    """``rows`` (id, weight, vector) with the nearest centre as ``pivot`` and a part of it as ``cell``, CELL rows or so each."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def nearest(batches):
        for b in batches:
            if b.num_rows:
                x = b[vector].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)
                got = np.concatenate([distances(x[k : k + 4096], centres).argmin(axis=1) for k in range(0, len(x), 4096)])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got.astype(np.int32))], [*b.schema.names, "pivot"])

    placed = rows.mapInArrow(nearest, f"{kinds}, pivot int")
    sizes = {r[0]: r[1] for r in placed.groupBy("pivot").count().collect()}
    parts = F.create_map(*[F.lit(x) for p, n in sorted(sizes.items()) for x in (p, -(-n // CELL))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    return placed.withColumn("cell", F.pmod(F.xxhash64("id"), parts[F.col("pivot")]).cast("int"))


def trees(cells: DataFrame, vector: str) -> DataFrame:
    """One row (pivot, cell, tree) for each cell of (id, weight, vector, pivot, cell)."""

    def grow(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        flat = t[vector].combine_chunks()
        points = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1).astype(float)
        tree = Tree.build(t["id"].to_numpy(), t["weight"].to_numpy(), points)
        return pa.table({"pivot": t["pivot"].slice(0, 1), "cell": t["cell"].slice(0, 1)} | {k: pa.array([v], pa.binary()) for k, v in tree.blobs().items()})

    return cells.groupBy("pivot", "cell").applyInArrow(grow, f"pivot int, cell int, {BLOB}")
