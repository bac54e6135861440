"""Skein: ordered, raster, stream and corpus analytics on PySpark DataFrames."""
