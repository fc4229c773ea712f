"""Pipelines of operators, and the registered queries."""
