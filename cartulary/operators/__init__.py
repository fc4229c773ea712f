"""Relational and domain operators over DataFrames."""
