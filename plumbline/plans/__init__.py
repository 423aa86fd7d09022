"""Whole queries: derived inputs, the query catalogue and the daily run."""
