"""Relational jobs: filters, joins, review, publication, analytics, search and reports."""
