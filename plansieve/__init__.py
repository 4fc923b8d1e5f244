"""Ensemble analytics of districting plans on Spark."""
