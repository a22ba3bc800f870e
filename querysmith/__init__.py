"""A PySpark-native engine for text-to-SQL data preparation and evaluation."""
