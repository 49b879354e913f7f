"""Grounded text retrieval over transcript tables, as Spark jobs."""

from turnstone.settings import Settings

__all__ = ["Settings"]
