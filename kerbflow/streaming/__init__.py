"""Structured Streaming variants of the rollups."""
