"""Named queries of the core and their DuckDB counterparts."""

from __future__ import annotations

from mutabik.queries import quality, recon


def all_queries() -> dict:
    return {**recon.QUERIES, **quality.QUERIES}


def all_oracles() -> dict:
    return {**recon.ORACLES, **quality.ORACLES}
