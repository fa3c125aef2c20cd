"""Importing this module registers every query."""

from shelfspark.plans import (  # noqa: F401
    attribute_queries,
    catalog_queries,
    change_queries,
    io_queries,
    matching_queries,
    monitoring_queries,
    quality_queries,
    registry_queries,
    text_queries,
)
