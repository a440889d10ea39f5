"""Content-addressed analytics on Spark."""
