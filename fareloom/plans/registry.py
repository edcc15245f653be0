"""All price-index queries and their DuckDB twins."""

from fareloom.plans import anomaly_queries, index_queries, record_queries, series_queries, store_queries, stream_queries, telemetry_queries

MODULES = (index_queries, anomaly_queries, series_queries, telemetry_queries, store_queries, record_queries, stream_queries)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
