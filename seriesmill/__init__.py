"""Spark-first retail analytics and forecasting."""
