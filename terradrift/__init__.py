"""Change analytics for rasters-as-tables and feature graphs, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
