"""Whole plans: batches of files, and the registered queries."""
