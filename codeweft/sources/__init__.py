"""Readers and writers: source trees, JSON exports, projections of tables."""
