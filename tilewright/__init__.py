"""Tile pyramids of raster images on PySpark."""
