"""Partitioned files in, metric store in and out."""
