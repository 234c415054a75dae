"""Readers and writers of pages, documents, sitemaps, logs and stage results."""

from lodeworks.sources.tables import TABLES, spread, table

__all__ = ["TABLES", "spread", "table"]
