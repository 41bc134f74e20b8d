"""A Spark-native engine for preparing training corpora."""
