"""A Spark-native analytics engine for tables that mix numbers, text, JSON and embeddings."""
