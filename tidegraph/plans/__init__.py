"""Query text to algebra (``parse``) and algebra to a DataFrame (``compile_plan``)."""

from .compiler import compile_plan, relevant
from .parser import ParseError, Query, parse

__all__ = ["ParseError", "Query", "compile_plan", "parse", "relevant"]
