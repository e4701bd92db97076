"""Operators of a training-data pipeline: quality, privacy, text extraction, tokens, duplicates."""
