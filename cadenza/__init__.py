"""Cadenza: symbolic-event analytics and training-data operators on Spark."""
