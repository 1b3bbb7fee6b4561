"""Spark-native multi-dialect analytics engine."""
