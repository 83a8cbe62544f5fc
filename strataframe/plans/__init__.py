"""Pipelines of table operators, and declarative configurations of them."""
