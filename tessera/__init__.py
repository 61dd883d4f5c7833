"""Tessera: a PySpark-native engine for hybrid document search and corpus processing."""

__version__ = "0.1.0"
