"""Spark-native network-traffic analytics."""
