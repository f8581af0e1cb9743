"""A PySpark-native engine for the catalog of a deduplicating object store."""
