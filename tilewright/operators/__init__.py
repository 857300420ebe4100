"""Operators on pixel, block and tile tables."""
