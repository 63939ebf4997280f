"""Inspection and yield analytics on Spark."""
