"""Spark-native retail line-item analytics and training-data preparation."""
