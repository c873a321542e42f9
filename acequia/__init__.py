"""acequia: a PySpark-native engine for collected, semi-structured records."""

__version__ = "0.1.0"
