"""Tessera: a Spark-native engine for test, code-graph and training-data analytics."""
