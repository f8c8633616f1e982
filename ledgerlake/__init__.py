"""Spark-native engine for table-lake state kept as a checkpoint plus an append-only log."""
