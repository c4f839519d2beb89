"""Spark-native sports event analytics and training-data operators."""
