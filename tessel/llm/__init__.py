"""Operators of a training-data pipeline: tokens, filters, joins, archives and search."""
