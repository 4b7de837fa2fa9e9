"""tracewell: Spark-native retrieval and analytics over append-only logs of typed, linked text records."""
