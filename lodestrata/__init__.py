"""Lodestrata: a Spark-native engine for repository-metadata collection and analysis."""
