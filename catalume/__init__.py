"""Catalog-discovery analytics on Spark DataFrames."""
