"""A Spark-native engine for variant, interval, sequence and report analytics."""
