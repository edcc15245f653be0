"""Price-index analytics on Spark."""
