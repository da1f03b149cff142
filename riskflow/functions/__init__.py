"""Column expressions: native Spark functions only, no Python in the row path."""
