"""Chalkline: Spark-native analytics for learning-content platforms."""
