"""Operators for large training-data pipelines: one module each, with queries in ``llm.queries``."""
