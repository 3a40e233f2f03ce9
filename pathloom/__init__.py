"""Session-path analytics on Spark."""
