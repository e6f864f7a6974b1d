"""Imports every module that registers queries."""

from checks import graph_queries, pipeline_queries, raster_queries  # noqa: F401
