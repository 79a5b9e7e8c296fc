"""Spark-native analytics for document and bibliographic libraries."""
