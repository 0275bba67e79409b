"""A PySpark-native catalogue matching, extraction and text-corpus engine."""
