"""Operators of a training-data pipeline: mixing, toxicity, personal data,
decontamination, nearest neighbours, secrets, near duplicates, URL filtering,
quality and language.  Nothing else in the library imports this subpackage.

Every module has a general operator (DataFrames in, DataFrames out, texts,
spans and models included); ``queries`` derives the registered digests.
"""
