"""Operators for training data. The rest of the library imports nothing from here."""
