"""Which nodes of a catalog can be reached from its maps, and what each packet lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.session import cut_lineage

# Layers a packet needs, the reasons by urgency, and the states of a packet that nothing can be done about.
LAYERS = ("summary", "statements", "evidence", "raw")
URGENT = ("not_navigable", "missing_evidence", "missing_raw", "packet_unreadable", "raw_file_missing")
IMPORTANT = ("missing_summary", "missing_statements", "packet_path_missing")
SEMANTIC = ("missing_statements", "missing_evidence")
NON_ACTIONABLE = ("manual_review_no_useful_content", "manual_review_source_only_no_statements", "manual_review_no_supported_items")
CONTENT_STATES = (*NON_ACTIONABLE, "manual_review_needs_gpu_ocr_or_visual_reextraction")
# Layers kept apart before they are put into one table.
LAYERS_APART = 8


def reach_layers(nodes: DataFrame, kind: str) -> DataFrame:
    """(id, layer): the fewest steps from a node of the type down to each node that has one above, 0 for the type itself; other nodes have no row.

    ``nodes`` are (id, parent_ids, object_type). Each round opens the nodes of the last layer only, and cuts its lineage, so that deep
    chains and cycles end when a layer is empty.
    """
    edges = cut_lineage(nodes.selectExpr("id", "explode(array_distinct(parent_ids)) AS parent"))
    last = cut_lineage(nodes.filter(F.col("object_type") == kind).select("id").distinct().withColumn("layer", F.lit(0)))
    apart, depth = [last], 0
    while last.limit(1).count():
        depth += 1
        below = edges.join(last.selectExpr("id AS parent"), "parent", "left_semi").select("id").distinct()
        for layer in apart:
            below = below.join(layer.select("id"), "id", "left_anti")
        last = cut_lineage(below.withColumn("layer", F.lit(depth)))
        apart.append(last)
        if len(apart) > LAYERS_APART:
            merged = apart[0]
            for layer in apart[1:]:
                merged = merged.unionByName(layer)
            apart = [cut_lineage(merged)]
    out = apart[0]
    for layer in apart[1:]:
        out = out.unionByName(layer)
    return out


def navigation_coverage(nodes: DataFrame, kind: str = "source_packet") -> DataFrame:
    """How each packet can be reached, what it lacks, and how urgent that is.

    ``nodes`` are (id, object_type, parent_ids, family_id, date_start, warnings, packet_path, packet_readable, summary, statements, evidence,
    raw_path, raw_exists). A packet is reached from a map if a parent, its family, or a node above them is one; from a family if its family is
    a family node; by its date if it has one. ``reasons`` come in a fixed order; a packet whose state says that nothing more can be done, and that
    lacks semantic layers only, has no priority.
    """
    reached = reach_layers(nodes.select("id", "parent_ids", "object_type"), "map")
    known = nodes.selectExpr("id AS _start", "object_type AS _kind").join(reached.withColumnRenamed("id", "_start"), "_start", "left")
    packets = nodes.filter(F.col("object_type") == kind)
    starts = packets.selectExpr(
        "id", "explode(concat(transform(array_distinct(parent_ids), p -> struct(p AS _start, false AS _family)), CASE WHEN family_id IS NULL THEN array() ELSE array(struct(family_id AS _start, true AS _family)) END)) AS s"
    ).select("id", "s.*")
    met = starts.join(known, "_start", "left").groupBy("id").agg(
        F.min("layer").alias("_layer"),
        F.coalesce(F.expr("bool_or(_family AND _kind = 'family')"), F.lit(False)).alias("_by_family"),
        F.count_if(F.expr("NOT _family AND _kind IS NULL")).alias("unresolved_parents"),
    )
    states = ", ".join(f"'{s}'" for s in sorted(CONTENT_STATES))
    rows = packets.join(met, "id", "left").selectExpr(
        "id",
        "CAST(_layer + 1 AS INT) AS map_layer",
        "_layer IS NOT NULL AS by_map",
        "coalesce(_by_family, false) AS by_family",
        "coalesce(date_start, '') <> '' AS by_date",
        "coalesce(unresolved_parents, 0L) AS unresolved_parents",
        "packet_path IS NULL AS _no_path",
        "packet_path IS NOT NULL AND NOT coalesce(packet_readable, false) AS _unreadable",
        "raw_path IS NOT NULL AND NOT coalesce(raw_exists, false) AS _raw_gone",
        "coalesce(summary, false) AS summary",
        "coalesce(statements, false) AS statements",
        "coalesce(evidence, false) AS evidence",
        "raw_path IS NOT NULL AND coalesce(raw_exists, false) AS raw",
        f"array_min(array_intersect(coalesce(warnings, array()), array({states}))) AS content_state",
    ).selectExpr("*", "by_map OR by_family OR by_date AS navigable")
    found = [
        ("packet_path_missing", "_no_path"), ("packet_unreadable", "_unreadable"), ("raw_file_missing", "_raw_gone"), ("not_navigable", "NOT navigable"),
        *[(f"missing_{layer}", f"NOT {layer}") for layer in LAYERS], ("unresolved_parent", "unresolved_parents > 0"),
    ]
    reasons = "filter(array(" + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in found) + "), r -> r IS NOT NULL)"
    listed = {name: "array(" + ", ".join(f"'{r}'" for r in group) + ")" for name, group in (("P0", URGENT), ("P1", IMPORTANT), ("quiet", SEMANTIC), ("closed", NON_ACTIONABLE))}
    quiet = f"array_contains({listed['closed']}, content_state) AND size(_r) > 0 AND size(array_except(_r, {listed['quiet']})) = 0"
    priority = f"CASE WHEN coalesce({quiet}, false) OR size(_r) = 0 THEN NULL WHEN arrays_overlap(_r, {listed['P0']}) THEN 'P0' WHEN arrays_overlap(_r, {listed['P1']}) THEN 'P1' ELSE 'P2' END"
    out = rows.selectExpr("*", f"{reasons} AS _r").selectExpr(
        "id", "by_map", "map_layer", "by_family", "by_date", "navigable", *LAYERS, "unresolved_parents", "content_state",
        "array_join(CASE WHEN content_state IS NULL THEN _r ELSE concat(_r, array(content_state)) END, ',') AS reasons", f"{priority} AS priority",
    )
    return out


def gap_queue(coverage: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` most urgent packets in order: by priority, then id."""
    top = coverage.filter("priority IS NOT NULL").orderBy("priority", "id").limit(n)
    return top.selectExpr("id", "priority", "reasons", "row_number() OVER (ORDER BY priority, id) AS place")


def coverage_totals(coverage: DataFrame) -> DataFrame:
    """One row: packets, those reached each way, those with each layer, orphans, and gaps by priority."""
    ways = {"navigable": "navigable", "from_map": "by_map", "from_family": "by_family", "from_date": "by_date", "orphans": "NOT navigable"} | {f"has_{x}": x for x in LAYERS}
    ways |= {p.lower(): f"priority = '{p}'" for p in ("P0", "P1", "P2")}
    return coverage.agg(F.count(F.lit(1)).alias("packets"), *[F.count_if(F.expr(c)).alias(name) for name, c in ways.items()])
