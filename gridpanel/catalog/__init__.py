"""Registered queries over the driver's tables, one per operator, and their SQL."""

from gridpanel.catalog.registry import ORACLES, QUERIES


def _load() -> None:
    from gridpanel.catalog import (  # noqa: F401
        grid_time,
        jobs,
        joins_sets,
        models_lookup,
        publish_gates,
        raster_climate,
        reprojection,
        scans,
        source_facts,
        stats_ranking,
        vector,
    )


def all_queries():
    _load()
    return dict(QUERIES)


def all_sql():
    _load()
    return dict(ORACLES)
