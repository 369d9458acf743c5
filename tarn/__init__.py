"""Ranked access to join answers, and training-data operators, on Spark."""
