"""SQL over files, on Spark."""
