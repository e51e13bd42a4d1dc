"""Raw data as DataFrames, one reader per source type."""

from .readers import load_source

__all__ = ["load_source"]
