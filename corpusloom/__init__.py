"""Spark-native preparation, auditing and evaluation of parallel text corpora."""
