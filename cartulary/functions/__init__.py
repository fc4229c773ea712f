"""Scalar functions: native column expressions, and Arrow functions where no expression exists."""
