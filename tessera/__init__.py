"""Tessera: a PySpark-native full-text retrieval engine."""
