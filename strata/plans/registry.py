"""All queries over the reference tables, with their SQL."""

from __future__ import annotations

from . import aggregates, changes, dialects, graphs, relational, temporal

FAMILIES = (relational, aggregates, temporal, graphs, changes, dialects)

QUERIES = {name: query for family in FAMILIES for name, query in family.R.queries.items()}
ORACLES = {name: sql for family in FAMILIES for name, sql in family.R.oracles.items()}
