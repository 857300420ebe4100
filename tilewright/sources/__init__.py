"""Rasters, codecs, documents and tile sinks."""
