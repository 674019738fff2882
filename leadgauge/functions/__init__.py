"""Column-level building blocks; all of them stay built-in Spark expressions."""
