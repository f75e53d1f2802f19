"""rillmark: a PySpark-native analytics engine for edge access logs."""
