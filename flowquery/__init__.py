"""A PySpark-native engine for semi-structured network-flow telemetry."""
