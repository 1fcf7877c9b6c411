"""A PySpark-native engine over the facts of source repositories."""
