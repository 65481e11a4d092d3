"""Operators for preparing training text: one module for each operator, and the queries over them."""
