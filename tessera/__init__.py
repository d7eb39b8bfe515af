"""Spark-first lambda analytics and model-serving engine."""
