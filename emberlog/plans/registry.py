"""All registered plans, collected from the per-area modules."""

from __future__ import annotations

from collections.abc import Callable

from emberlog.plans import (
    queries_detectors,
    queries_features,
    queries_sequences,
    queries_sessions,
    queries_streaming,
)

AREAS = (queries_sessions, queries_sequences, queries_features, queries_detectors, queries_streaming)


def queries() -> dict[str, Callable]:
    return {name: plan for area in AREAS for name, plan in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in area.ORACLE.items()}
