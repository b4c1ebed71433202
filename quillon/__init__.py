"""quillon: a Spark-native engine for curating, rewriting and scoring conversation records."""
