"""Raster and text-region analytics on Spark DataFrames."""
