"""Column functions: all built from Spark's own expressions, so they stay in generated code, but for masking JSON."""
