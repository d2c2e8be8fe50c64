"""Operators of a training-data pipeline: packing, filtering, joins, mixing, scoring."""
