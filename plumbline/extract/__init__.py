"""Table functions from source text to units and tokens."""
