"""Spark-native factor analytics."""
