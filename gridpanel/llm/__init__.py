"""Operators over text tables for training-data pipelines; nothing else in the package imports them."""
