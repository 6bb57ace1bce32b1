"""loomlog: a PySpark-native engine for branching, append-only record logs."""

__version__ = "0.1.0"
