"""Column builders for RDF terms and their typed comparison."""

from .terms import compare, kind, number, text_value

__all__ = ["compare", "kind", "number", "text_value"]
