"""quillon: a PySpark-native analytics engine."""
