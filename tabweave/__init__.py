"""Tabular consolidation and training-data operators expressed as Spark plans."""
