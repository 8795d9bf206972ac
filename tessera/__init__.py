"""Tessera: a PySpark engine for datasets of structured model outputs."""

__version__ = "0.1.0"
