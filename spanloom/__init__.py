"""spanloom: Spark-native extraction scoring, graph retrieval and corpus preparation."""
