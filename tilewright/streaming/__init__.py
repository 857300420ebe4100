"""Strips that arrive one at a time."""
