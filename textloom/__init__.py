"""Content-corpus analytics on Spark."""
