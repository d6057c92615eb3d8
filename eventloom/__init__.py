"""Spark-native batch analytics for large machine-event logs."""
