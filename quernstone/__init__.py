"""A Spark-native engine for knowledge graphs, retrieval and their evaluation."""
