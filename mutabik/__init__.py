"""Spark-native payment reconciliation and data-quality operators."""
