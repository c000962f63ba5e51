"""Calyx: document-data analytics expressed as Spark DataFrame plans."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
