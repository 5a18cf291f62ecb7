"""Spark-native analytics engine: versioned tables, vector search, near-duplicate detection and training exports."""
