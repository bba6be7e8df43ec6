"""The SQL dialect: text to tokens, tokens to trees, trees to DataFrames."""

from .lower import Lowering, explain_text
from .parser import ParseError, parse

__all__ = ["Lowering", "ParseError", "explain_text", "parse"]
