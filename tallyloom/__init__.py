"""A PySpark-native engine for matching requirements to catalogs."""
