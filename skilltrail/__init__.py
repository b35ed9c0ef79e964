"""Skills-to-careers analytics as PySpark DataFrame operations."""
