"""Operators of a training-data pipeline: archives, tokens, quality, duplicates, language, scoring, packing."""
