"""The registered queries of the core and the SQL they are checked against."""

from __future__ import annotations

from lumenframe.plans import anomalies, arrays, catalog, planning, relations, scoring, series, store, timeline

FAMILIES = (timeline, planning, scoring, arrays, series, relations, catalog, store, anomalies)
QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
SQL = {name: text for family in FAMILIES for name, text in family.SQL.items()}
