"""Spark-native record matching: features, joins, similarity, ranking and their evaluation."""
