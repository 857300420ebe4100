"""Operators for training-data corpora; see the modules for their contracts."""
