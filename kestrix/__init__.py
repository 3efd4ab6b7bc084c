"""A PySpark-native engine for decision-record analytics."""
