"""Spark-native engine for grounded document search and corpus preparation."""
