"""Column-level building blocks; everything here is a Spark SQL expression."""
