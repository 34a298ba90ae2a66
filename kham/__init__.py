"""Document-text analytics on Spark."""
