"""Spark-native analytics over timed note events, manifests and token streams."""
