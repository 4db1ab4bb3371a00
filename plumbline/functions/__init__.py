"""Column expressions: names, buckets, values."""
