"""Transcript capture, retrieval and analytics on Spark."""
