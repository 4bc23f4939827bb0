"""A Spark-native analytics library for spatial, event and business data."""
