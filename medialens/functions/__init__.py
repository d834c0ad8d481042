"""Column-returning helpers (labels, periods, text, dates). All are native Spark expressions."""
