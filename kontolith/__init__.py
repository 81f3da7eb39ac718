"""Kontolith: a Spark-native engine for statement ledgers, from recognised text to reconciled, enriched and masked views."""

__version__ = "0.1.0"
