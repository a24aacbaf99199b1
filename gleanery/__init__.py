"""Spark-native page extraction and crawl analytics."""
