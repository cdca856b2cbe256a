"""quern: a PySpark-native engine for preparing and evaluating text corpora."""

__version__ = "0.1.0"
