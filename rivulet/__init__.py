"""Rivulet: a Spark-native engine for flow analytics."""
