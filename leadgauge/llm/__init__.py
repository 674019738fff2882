"""Operators of a training-data pipeline. Nothing else of the library imports this package."""
