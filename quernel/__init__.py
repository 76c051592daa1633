"""A Spark-native engine for searching and navigating text and source corpora."""
