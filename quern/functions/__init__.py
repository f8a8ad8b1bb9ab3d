"""Column functions: they take and return Columns and stay inside Spark's generated code."""
