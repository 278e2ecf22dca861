"""Operators of a training-data pipeline. Nothing else in fieldloom imports this package."""
