"""Operators of a training-data pipeline: sharding, language, secrets, quality, joins, search, mixing."""
