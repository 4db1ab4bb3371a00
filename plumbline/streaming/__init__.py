"""Cache folders as streams."""
