"""Spark-native analytics over software change records and training-data corpora."""
