"""Relational operators over units, calls, tokens and coverage."""
