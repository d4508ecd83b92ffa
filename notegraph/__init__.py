"""Note-graph retrieval on Spark."""
