"""The query language: text to a syntax tree."""
from .parser import ParseError, parse, parse_expression

__all__ = ["ParseError", "parse", "parse_expression"]
