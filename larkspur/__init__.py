"""Spark-native hybrid product search and catalogue processing."""
