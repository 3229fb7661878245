"""Spark-native engine for binning assembled sequences; see README.md."""
