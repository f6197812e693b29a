"""Features and models."""
