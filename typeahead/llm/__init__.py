"""Operators for preparing large-scale training text, one module per operator."""
