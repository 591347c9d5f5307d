"""Spark-native search, expression and validation engine for versioned clinical documents."""
