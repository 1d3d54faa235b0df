"""Hybrid document retrieval and its analytics as Spark DataFrame plans."""
