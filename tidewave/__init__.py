"""Pulse-signal analytics on Spark: long tables of samples keyed by subject, condition, method and region."""
