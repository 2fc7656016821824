"""Operators for training-data pipelines over text, vector and chat tables."""
