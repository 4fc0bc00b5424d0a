"""Incremental processing and progress."""
