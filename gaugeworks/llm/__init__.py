"""Operators of a training-data pipeline over document, conversation and benchmark tables."""
