"""Spark-native analytics over multi-stage findings pipelines and training corpora."""
