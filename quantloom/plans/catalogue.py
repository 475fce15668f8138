"""All queries of the core and their SQL."""

from quantloom.plans import corpus_queries, prepared, roster_queries, score_queries, series_queries, sim_queries

_PARTS = (score_queries, series_queries, sim_queries, corpus_queries, roster_queries, prepared)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
