"""A Spark-native graph memory: ingest triples, resolve entities, maintain, retrieve and reason with DataFrames."""
