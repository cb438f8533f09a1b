"""quarry: a Spark-native engine for schema intelligence over table catalogs."""
