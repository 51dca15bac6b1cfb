"""All queries of the memory engine and the SQL they must equal."""

from __future__ import annotations

from recallforge.plans import edges, retrieval, runs, scalars, segments, upkeep

QUERIES = {**scalars.QUERIES, **segments.QUERIES, **retrieval.QUERIES, **upkeep.QUERIES, **edges.QUERIES, **runs.QUERIES}


def queries():
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql():
    return {k: sql for k, (_, sql) in QUERIES.items()}
