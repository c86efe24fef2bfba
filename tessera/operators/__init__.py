"""Filters, sorting, aggregates, change logs, constraints."""
