"""Measurement queries over the supplied tables, each a use of library operators, with SQL that gives the same rows."""

from __future__ import annotations

from gaugeworks.queries import analysis, catalogue, curated, fights, gearsweep, loadouts, paging, published, reported, sweeps  # noqa: F401  they register themselves
from gaugeworks.queries.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
