"""Spark-native operators for operational data: lazy functions from DataFrame to DataFrame."""
