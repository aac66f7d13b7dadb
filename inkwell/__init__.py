"""Inkwell: a PySpark-native engine for preparing, auditing and scoring text training data."""
