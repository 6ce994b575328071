"""Operators on frames: as-of joins, sampling and indexing, group statistics, windows, sparse algebra, metrics."""
