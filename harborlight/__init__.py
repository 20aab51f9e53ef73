"""Station-availability analytics on Spark."""
