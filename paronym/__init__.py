"""Spark-native engine that compares pairs of short names and prepares pair and text collections."""
