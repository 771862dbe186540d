"""Text cleaning and similarity search on Spark."""
