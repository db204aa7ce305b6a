"""Spark-native analytics for agent-platform data."""
