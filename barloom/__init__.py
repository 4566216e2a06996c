"""Daily-bar panel analytics on Spark."""
