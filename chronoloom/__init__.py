"""Spark-native analytics over recorded multi-stream sensor sessions."""
