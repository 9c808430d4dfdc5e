"""chartwise: Spark-native analytics for clinical event and irregular time-series tables."""
