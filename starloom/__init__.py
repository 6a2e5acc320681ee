"""Spark-native dimensional and graph analytics."""
