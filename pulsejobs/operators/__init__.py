"""Operators on tables of records, windows, cycles, features and predictions."""
