"""All registered queries, grouped by operator family."""

from __future__ import annotations

import importlib

from echoloom.catalog.registry import ORACLES, QUERIES

FAMILIES = ["q_metrics", "q_sampling", "q_joins", "q_streams", "q_arrays", "q_models", "q_streaming", "q_scan", "q_content", "q_builds"]


def _load() -> None:
    for name in FAMILIES:
        importlib.import_module(f"echoloom.catalog.{name}")


def queries():
    _load()
    return dict(QUERIES)


def oracles():
    _load()
    return dict(ORACLES)
