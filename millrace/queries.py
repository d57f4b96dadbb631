"""Every registered query of the library, and its SQL."""

from __future__ import annotations

from millrace.plans import cascade, evaluation, extraction, gold, relations, reports, scenarios, selection, streams, timeseries

MODULES = [cascade, selection, gold, timeseries, extraction, relations, scenarios, evaluation, streams, reports]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
ENTRY = cascade.rule_cascade_funnel
