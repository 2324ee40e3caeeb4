"""Operators of a training-data pipeline: packing, filters, tokens, licences, search, secrets, copies, language, models."""
