"""tablewright: a Spark-native engine for typing, comparing and validating tables."""
