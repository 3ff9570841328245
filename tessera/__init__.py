"""Place-and-time analytics on Spark."""
