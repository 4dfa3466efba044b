"""Spark-native analytics over market-style tables: bars, signals, labels, screens and statistics."""
