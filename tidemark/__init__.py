"""Spark-first analytics for transcript, subtitle and training-text collections."""
