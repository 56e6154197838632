"""Composed plans: the resolution pipeline, reports and registered queries."""
