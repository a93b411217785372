"""Registered queries over the driver tables, each with its DuckDB counterpart."""

from parity import annotation, catalog, indexes, ingest, pages, plans, resolution

REGISTRY = {
    **catalog.QUERIES, **annotation.QUERIES, **ingest.QUERIES, **resolution.QUERIES,
    **pages.QUERIES, **plans.QUERIES, **indexes.QUERIES,
}
