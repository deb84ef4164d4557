"""Operators for preparing training data: filters, joins, mixing, packing, search."""
