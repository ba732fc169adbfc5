"""Append-only logs as streams."""
