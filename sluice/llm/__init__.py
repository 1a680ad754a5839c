"""Operators of a training-data pipeline: packing, language, quality, tokens, dedup, licences, mixing, toxicity."""
