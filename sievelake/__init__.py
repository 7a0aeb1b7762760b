"""Hybrid retrieval and training-data operators as Spark plans."""
