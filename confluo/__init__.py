"""confluo: a Spark-native engine for environmental panels, river networks and estimation."""
