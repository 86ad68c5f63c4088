"""Operators of a training-data pipeline: corpus cleaning, scoring, encoding, mixing and search."""
