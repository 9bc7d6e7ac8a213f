"""Connected components of a link table, by alternating stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.session import cut_lineage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    Each round rewrites the links to point at smaller nodes of the same component: first those to larger
    neighbours, then those to smaller ones. The loop ends when a round changes nothing, at stars around the
    smallest nodes. Self links and repeated links are fine; an empty table gives an empty one.
    """
    edges = edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()
    edges = cut_lineage(edges)
    seen = _mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        large = both.where("b > a").join(least, "a").selectExpr("b AS a", "m AS b").where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").selectExpr("b AS a", "m AS b").where("a <> b")
        edges = cut_lineage(small.unionByName(low.selectExpr("a", "m AS b")).distinct())
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    nodes = edges.groupBy("a").agg(F.min("b").alias("component")).selectExpr("a AS node", "component")
    return nodes.unionByName(nodes.selectExpr("component AS node", "component").distinct())


def local_labels(n: int, i, j, labels=None):
    """Smallest member of each component of the links (i, j) among ``n`` items of one group, in numpy."""
    import numpy as np

    labels = np.arange(n) if labels is None else labels
    while len(i):
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        np.minimum.at(labels, i, low)
        np.minimum.at(labels, j, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels
