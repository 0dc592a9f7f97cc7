"""The registered queries of the rain, terrain and flood operators."""

from __future__ import annotations

from torrentia.plans import climate_queries, flood_queries, geometry_queries, raster_queries, terrain_queries, vector_queries

MODULES = (climate_queries, raster_queries, terrain_queries, geometry_queries, flood_queries, vector_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
