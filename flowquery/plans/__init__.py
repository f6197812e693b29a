"""The query catalogue that binds operators to tables."""
