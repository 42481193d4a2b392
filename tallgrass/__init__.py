"""tallgrass: a PySpark-native analytics engine for longitudinal, event-ordered records."""
