"""Readers: Parquet tables, Markdown stores, transcripts."""

from cairn.sources.tables import table

__all__ = ["table"]
