"""Spark-native code and text retrieval analytics: DataFrames in, DataFrames out."""
