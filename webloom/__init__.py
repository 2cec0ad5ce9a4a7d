"""A PySpark-native engine for web content: extraction, scoring, ranking, retrieval."""
