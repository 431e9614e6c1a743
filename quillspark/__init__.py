"""Batch retrieval analytics over document collections, as DataFrame plans."""
