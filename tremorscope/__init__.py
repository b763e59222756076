"""A Spark-native engine for repeated measurements by a noisy judge."""
