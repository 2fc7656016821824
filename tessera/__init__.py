"""A PySpark-native engine for spatially partitioned point data and text corpora."""
