"""Spark-native analytics over a corpus of documents and the statements drawn from them."""
