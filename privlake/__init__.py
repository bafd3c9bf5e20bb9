"""Privacy analytics over document collections, as Spark DataFrame operations."""
