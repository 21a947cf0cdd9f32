"""Spark-native structure analytics over hierarchies, references and graphs."""
