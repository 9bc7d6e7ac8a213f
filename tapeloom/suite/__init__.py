"""Registered queries over the given tables, each with the DuckDB SQL it must agree with."""

from __future__ import annotations

from importlib import import_module

AREAS = (
    "indicators",
    "brick",
    "waves",
    "features",
    "ticks",
    "market",
    "stats",
    "quality",
    "calibration",
    "flows",
    "catalog",
    "patterns",
    "sources",
)


def load() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for area in AREAS:
        module = import_module(f"tapeloom.suite.{area}")
        clash = queries.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"query names registered twice: {sorted(clash)}")
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles
