"""Readers: unit and token caches, coverage, diffs, configuration, files, git."""
