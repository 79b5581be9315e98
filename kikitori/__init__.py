"""Spark-native operators for speech and text corpora: curation, segments, evaluation, training-data preparation."""
