"""Operators of a training-data pipeline: formatting, quality rules, extraction, duplicates, packing, scoring."""
