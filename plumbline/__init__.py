"""Plumbline: code-health analytics as Spark plans."""
