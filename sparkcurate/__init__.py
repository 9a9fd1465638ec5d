"""Spark-native curation of conversation data, evaluation analytics and session folds."""
