"""Operators on panels, features and evaluation tables."""
