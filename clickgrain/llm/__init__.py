"""Operators of a training-data pipeline. ``catalog`` has them as queries over the test tables."""
