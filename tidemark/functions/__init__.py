"""Spark-first transcript processing."""
