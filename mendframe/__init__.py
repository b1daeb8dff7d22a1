"""Spark-native detection, repair and quarantine of silent data corruption."""
