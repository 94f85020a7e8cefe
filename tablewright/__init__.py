"""tablewright: Spark-native retrieval and analytics over nested tables and parsed documents."""
