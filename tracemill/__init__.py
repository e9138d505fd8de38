"""A Spark-native analytics engine for session events."""
