"""A Spark-native engine for sequence assembly and read-set analytics."""
