"""Operators of a training-data pipeline: classifiers, near duplicates, repeated passages, mixing and sharding."""
