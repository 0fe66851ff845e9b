"""Relational operators: filters, joins, aggregates, windows, scenarios."""
