"""Spark-native procurement analytics: every operator is a function on DataFrames or Columns."""
