"""All queries of the engine and their SQL."""

from __future__ import annotations

from loomgrid.plans import assignments, building, detection, geometry, pointsets, records, storage, streams, texts

MODULES = (detection, records, geometry, assignments, pointsets, texts, building, storage, streams)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _m in MODULES:
    assert not QUERIES.keys() & _m.QUERIES.keys()
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
