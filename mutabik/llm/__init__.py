"""Operators for training-data pipelines that work on texts and noisy records."""
