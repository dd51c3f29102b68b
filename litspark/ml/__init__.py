"""Spark ML training, fold loops and batch scoring."""
