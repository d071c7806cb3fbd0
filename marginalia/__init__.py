"""Analytics over annotated document collections, expressed as Spark DataFrame operations."""
