"""semgraph: a PySpark-native analytics engine for semantic code graphs."""

__version__ = "0.1.0"
