"""A Spark-native engine that organises technical documents: validate, clean, deduplicate, describe, classify, search, report."""
