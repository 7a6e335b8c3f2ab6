"""Operators of a training-data pipeline over web text. Nothing outside this package imports it."""
