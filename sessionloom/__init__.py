"""Web-analytics sessions, star schema, funnels and metrics as PySpark DataFrame operators."""

from sessionloom.config import Settings

__all__ = ["Settings"]
