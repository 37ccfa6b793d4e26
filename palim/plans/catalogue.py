"""The query catalogue: name to DataFrame plan, and name to oracle SQL."""

from __future__ import annotations

from palim.plans import consolidating, reading, retrieving, scoring, segmenting

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (retrieving, segmenting, consolidating, scoring, reading):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
