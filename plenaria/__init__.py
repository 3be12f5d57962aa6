"""Spark-native analytics for meeting and parliamentary records."""
