"""A Spark-native engine for multi-dimensional reports with mergeable metric states."""
