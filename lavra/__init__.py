"""lavra: a PySpark-native engine for data catalogs, masking, source retrieval and evaluation."""

__version__ = "0.1.0"
