"""Column expressions: pure builders that never start a Spark job."""
