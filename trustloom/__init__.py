"""Spark-native assurance analytics over datasets, models and inference events."""
