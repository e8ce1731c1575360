"""Spark-native engine for dialogue data, rule scoring and preference evaluation."""
