"""Operators for training data: text search, models, privacy and archives."""
