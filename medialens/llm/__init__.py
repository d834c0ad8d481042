"""Operators of a training-data pipeline: dedup, quality, decontamination, tokens, HTML, LM scores, PII, licences."""
