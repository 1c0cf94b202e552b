"""A PySpark-native market analytics engine: bars, indicators, signals, fundamentals, documents, vectors."""
