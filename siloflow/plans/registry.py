"""All registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from siloflow.plans import cases, sites, text

QUERIES = text.QUERIES | sites.QUERIES | cases.QUERIES
ORACLE: dict[str, str] = text.ORACLE | sites.ORACLE | cases.ORACLE
