"""Spark-native document ingest, retrieval and knowledge-graph analytics."""
