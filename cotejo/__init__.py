"""Spark-native reconciliation of tabular files, declarative record files and corpus preparation."""
