"""Operators over DataFrames of the catalog and the block store."""
