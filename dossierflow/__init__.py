"""Spark-native document matching, scoring and corpus preparation."""
