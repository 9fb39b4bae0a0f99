"""A PySpark-native engine for dependency-graph, code-quality and evaluation data."""
