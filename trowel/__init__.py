"""Trowel: a PySpark-native engine for code archaeology over fact tables."""

__version__ = "0.1.0"
