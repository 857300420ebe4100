"""Pyramid plans, manifests and jobs."""
