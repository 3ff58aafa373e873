"""pairscope: a PySpark-native analytics engine for paired bilingual text."""

__version__ = "0.1.0"
