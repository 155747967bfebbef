"""Operators on records and texts for training data. Nothing else in the package imports this folder."""
