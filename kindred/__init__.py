"""Spark-native entity resolution: clean, block, pair, score, cluster and serve party records."""
