"""Concept-graph and evidence analytics on Spark."""
