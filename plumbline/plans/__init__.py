"""Whole plans: the report, and the adapters and queries of the test tables."""
