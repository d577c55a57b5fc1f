"""A PySpark-native engine for content-addressed triples."""
