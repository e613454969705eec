"""Spark-native clustering summaries and training-data operators."""
