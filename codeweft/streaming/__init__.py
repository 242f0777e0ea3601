"""Snapshot differences and refresh on Structured Streaming."""
