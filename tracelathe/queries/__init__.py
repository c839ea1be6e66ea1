"""Named queries over the driver's tables, with the SQL that each equals."""

from tracelathe.queries import analysis, checks, events, features, records, tables_queries

_PARTS = (events, analysis, tables_queries, records, features, checks)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: text for part in _PARTS for name, text in part.ORACLES.items()}
